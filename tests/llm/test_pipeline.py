"""The pipeline's stages against plain versions, and odd inputs."""

import re
from collections import Counter

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from tablesight.plans.verify import compare, oracle_connection

from .test_minhash import brute as near_groups
from .test_suffix import brute as repeats
from .test_tokens_packing import check_packing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    from tablesight.llm.shared import Scratch
    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(scratch.put(stage(spark, out[-1], SF)))
    return out


def test_stage_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "suffix_dedup", "mixing", "packing"]
    for df in stages[:-1]:
        assert df.columns == COLUMNS


def test_toxic_documents_go(spark, stages):
    before, after = ({r.doc_id for r in df.select("doc_id").collect()} for df in stages[:2])
    score = {r.doc_id: r.predicted for r in entry.queries()["op7_toxicity"](spark, SF).collect()}
    assert after == {d for d in before if score[d] == 0}


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(g[0] for g in near_groups(rows, 80) if g[3])


def test_stage_links_at_80_percent(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:20] + ["a"] + base[21:70] + ["b"] + base[71:])), (3, " ".join(f"v{i}" for i in range(100)))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == sorted(g[0] for g in near_groups(rows, 80) if g[3]) == [1, 3]


def test_repeats_are_cut(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {r[0]: (r[1] - r[2], r[3]) for r in repeats(rows)}
    for r in stages[3].collect():
        left, spans = want[r.doc_id]
        assert left - 4 * spans <= len(r.text.encode()) <= left and r.n_chars == len(r.text)


def test_mix(spark, stages):
    from tablesight.llm import mixing
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == {d: n for d, n in copies.items() if n}
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect())
    assert abs(size(stages[4]) / size(stages[3]) - 1.5) < 0.2


def test_packing(stages):
    import public_tokenizers
    from tokenizers import Tokenizer
    lengths = Counter()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages[4].collect():
        lengths[r.doc_id] += len(library.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for p in stages[5].collect():
        got[p.doc_id] += p.length
    assert got == lengths
    assert callable(check_packing)


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sum(r.length for r in got.collect()) == sum(r.length for r in stages[5].collect())
    assert {r.doc_id for r in got.collect()} == {key(r)[0] for r in stages[5].collect()}


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, 1, "s"), (2, "", "en", None, 0, 1, "s"), (None, "x y", "en", "s", 3, 1, "s"),
            (3, "same text here " * 30, "en", "s", 1, 1, "s"), (3, "same text here " * 30, "en", "s", 1, 1, "s"), (4, "z" * 100_000, "en", "s", 1, 1, "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, predicted int, kept string"
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
            if name != "packing":
                assert docs.columns == columns


@pytest.mark.parametrize("name", ["op3_url_filters", "op9_mixing"])
def test_oracles(spark, name):
    ok, message = compare(entry.queries()[name](spark, SF), oracle_connection(SF), entry.oracle_sql()[name])
    assert ok, message


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
