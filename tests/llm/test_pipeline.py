import subprocess
import sys

import corpus_pipeline as C
from ledgerlens.llm import decontam, simhash

from . import test_line_dedup, test_mixing, test_simhash
from .cases import no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = dict(C.STAGES)
    one = stage["language"](spark, docs, SF)
    rows = {r.doc_id: r for r in one.collect()}
    assert one.columns == columns and set(rows) == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    two = stage["lines"](spark, docs, SF)
    got = {r.doc_id: r for r in two.collect()}
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert two.columns == columns
    test_line_dedup.assert_deduplicated(pairs, {i: got[i].text if i in got else None if t is None else "" for i, t in pairs})
    assert all(r.n_chars == len(r.text) for r in got.values())
    three = stage["near_copies"](spark, docs, SF)
    prints = {r.doc_id: test_simhash.fingerprint(r.text) for r in docs.collect()}
    comp = test_simhash.components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert three.columns == columns and sorted(r.doc_id for r in three.collect()) == sorted(set(comp.values()))
    four = stage["decontaminate"](spark, docs, SF)
    index = decontam.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert four.columns == columns
    assert sorted(r.doc_id for r in four.collect()) == sorted(r.doc_id for r in docs.collect() if not index.overlaps([r.text]))
    five = stage["mix"](spark, docs, SF)
    copies = {}
    for r in five.collect():
        copies.setdefault(r.doc_id, []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 2 for c in copies.values())
    sizes, taken = {}, {}
    for r in docs.collect():
        n = len((r.text or "").encode().split())
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + n * len(copies.get(r.doc_id, []))
    target = test_mixing.water_fill(sizes)
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 200) for s in sizes)


def test_run_equals_the_stages(spark):
    out = C.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
    key = lambda r: (r.doc_id, r["copy"])
    assert sorted(out, key=key) == sorted(docs.collect(), key=key)


def test_odd_cases(spark):
    for start in (odd_docs(spark), no_docs(spark)):
        docs = start
        for _, stage in C.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        assert docs.count() <= 2 * start.count()


def test_clashing_columns_ids_and_repeated_rows(spark):
    docs = odd_docs(spark)
    for name in ("size", "target", "copy", "_copies", "_key", "key", "row", "_n", "_ld", "_ld_id", "_ld_kept", "_ld_h", "lines_removed", "th", "fp"):
        docs = docs.withColumn(name, docs.lang)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r._ld_kept for r in out.filter("doc_id = 8").collect()} == {"de"} and out.count() > 0
    taken = C.mix(spark, docs, SF).collect()
    assert {r._copies for r in taken if r.doc_id == 8} <= {"de"} and all(isinstance(r["copy"], int) for r in taken)
    # equal rows count each: a source of a hundred equal documents still comes near its target
    many = spark.createDataFrame([(1, "w " * 10, "en", "a", 20)] * 100 + [(2, "x " * 500, "en", "b", 1000)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = C.mix(spark, many, SF).collect()
    target = {r.source: r.target for r in mixed}
    got = {s: sum(r["size"] for r in mixed if r.source == s) for s in target}
    assert abs(got["a"] - target["a"]) <= 10 and sorted(r["copy"] for r in mixed if r.source == "a") == list(range(1, got["a"] // 10 + 1))
    named = odd_docs(spark)
    named = named.withColumn("doc_id", named.doc_id.cast("string"))
    for _, stage in C.STAGES:
        stage(spark, named, SF).count()


def test_entry_without_this_package():
    code = ("import sys\nsys.modules['ledgerlens.llm'] = None\nimport __spark_entry__ as e\n"
            "assert e.llm_queries is None and 'kpis' in e.queries() and 'pipeline' not in e.queries()\ne.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=C.__file__.rsplit("/", 1)[0])
