import glob

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from brute import jaccard
from stratalog.llm import queries as q
from stratalog.llm.common import scratch
from stratalog.llm.decontaminate import contaminated
from stratalog.llm.exact_dedup import exact_dedup
from stratalog.llm.line_dedup import line_dedup
from stratalog.llm.toxicity import toxicity


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1].split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(q.oracle_sql()[name]).df()
    mine = q.queries()[name](spark, sf).toPandas()[list(want.columns)]
    key = list(want.columns)
    tidy = lambda d: d.sort_values(key).reset_index(drop=True).astype(object).where(d.notna().sort_index(), None)
    pd.testing.assert_frame_equal(tidy(mine), tidy(want), check_dtype=False)


def test_pipeline_step_by_step(spark, sf):
    """Each stage against the plain version or the operator's own query on its input."""
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    stage = dict(corpus_pipeline.STAGES)
    one = stage["toxicity"](spark, docs, sf).cache()
    assert one.columns == docs.columns and ids(one) == ids(toxicity(docs, labels).where("predicted = 0"))
    two = stage["line_dedup"](spark, one, sf).cache()
    assert ids(two) == ids(one) and two.columns == docs.columns
    assert {(r.doc_id, r.text) for r in two.collect()} == {(r.doc_id, r.text) for r in line_dedup(one, least_tokens=1).select("row.*").collect()}
    three = stage["jaccard_join"](spark, two, sf).cache()
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert ids(three) == {d for d, _, c, _ in jaccard(rows) if d == c} and three.columns == docs.columns
    four = stage["decontamination"](spark, three, sf).cache()
    assert ids(four) == ids(three) - ids(contaminated(three, bench))
    five = stage["sentencepiece"](spark, four, sf)
    assert ids(five) == ids(four) and five.where("not round_trip").count() == 0
    assert ids(corpus_pipeline.run(spark, sf)) == ids(five)


def test_pipeline_of_odd_rows(spark, sf, docs, tmp_path):
    """Nulls, empty and repeated rows, rows that share an id, and names that clash with ours."""
    near = " ".join(f"w{i}" for i in range(40))
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, near), (None, near + " more"), (5, near + " x"), (5, "another text of its own"), (5, None), (6, ""), (6, ""), (None, None)]
    rows += [(7, f"q r s {leak} t u"), (None, f"q r s {leak} t u"), (7, "clean words stay here"), (8, "twice the same"), (8, "twice the same")]
    frame = docs(rows)
    stage = dict(corpus_pipeline.STAGES)
    near_left = stage["jaccard_join"](spark, frame, sf)
    assert near_left.columns == frame.columns
    left = sorted((r.doc_id or 0, r.text or "") for r in near_left.collect())
    # Copies go, also under a null id; blank rows are alone; a row repeated whole stays once.
    assert left == sorted([(5, near + " x"), (5, "another text of its own"), (5, ""), (6, ""), (6, ""), (0, ""), (7, f"q r s {leak} t u"), (7, "clean words stay here"), (8, "twice the same")])
    leaks_left = stage["decontamination"](spark, frame, sf)
    assert leaks_left.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in leaks_left.collect()) == sorted((d or 0, t or "") for d, t in rows if leak not in (t or ""))
    assert stage["line_dedup"](spark, frame, sf).count() == len(rows)
    assert stage["sentencepiece"](spark, frame, sf).count() == len(rows)
    none = docs([])
    assert stage["jaccard_join"](spark, none, sf).count() == stage["decontamination"](spark, none, sf).count() == 0


def test_scratch_tables_belong_to_their_scope(spark, docs):
    rows = [(1, "a b c"), (2, "a b c"), (3, "d")]
    early = exact_dedup(docs(rows))
    with scratch(spark) as made:
        late = exact_dedup(docs(rows))
        assert late.count() == 3 and made.paths
    made.delete()
    assert early.count() == 3 and not made.paths
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        late.count()
