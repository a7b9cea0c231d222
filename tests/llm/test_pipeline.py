import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES
from tests.conftest import SF001, SF0001


def test_registered():
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == [q for n in range(1, 14) for q in QUERIES if q.startswith(f"op{n}_")]
    assert len(QUERIES) == 13 and set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    relation = con.sql(ORACLE[name])
    want = relation.fetchall()
    found = QUERIES[name](spark, SF001)
    assert sorted(found.columns) == sorted(relation.columns)
    got = [tuple(r[c] for c in relation.columns) for r in found.collect()]
    assert sorted(got) == sorted(want)


def test_each_stage_on_its_own_input(spark, make_docs, edge_rows, tmp_path):
    """Stages against what their operators say, on the table and on odd rows."""
    from tidemark.llm import decontam, langid, secret_scan, simhash
    from tidemark.llm.common import fold, table
    docs = table(spark, SF0001, "documents").unionByName(
        make_docs([(r[0] and r[0] + 10**6, *r[1:]) for r in edge_rows], extra=False)).selectExpr("*", "1 as fp", "2 as hits", "'q' as spans")
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF0001)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(C.STAGES) - 1:
            assert out.columns == C.COLUMNS
        before, after = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        ids = lambda rows: sorted(str(r["doc_id"]) for r in rows)
        if name == "language_id":
            said = langid.predict(docs, langid.train(docs, fold("doc_id", 4) != 2)).where("not rejected").collect()
            assert ids(after) == ids(r.asDict() for r in said) and len(after) < len(before)
        elif name == "simhash_near_dedup":
            groups = simhash.simhash_components(docs).collect()
            assert sorted({r["component_id"] for r in groups if r["component_id"] is not None}) == sorted(r["doc_id"] for r in after if r["doc_id"] is not None)
            assert len(after) == len({r["component_id"] for r in groups})
        elif name == "benchmark_decontamination":
            bad = {r["doc_id"] for r in decontam.contamination(docs, table(spark, SF0001, "benchmark")).where("contaminated").collect()}
            assert ids(after) == ids(r for r in before if r["doc_id"] not in bad)
        elif name == "secret_scan":
            assert ids(after) == ids(before)
            assert not any(secret_scan.base_spans(r["text"]) for r in after)
            same = {r["doc_id"]: r["text"] for r in before if not secret_scan.base_spans(r["text"])}
            assert all(r["text"] == same[r["doc_id"]] for r in after if r["doc_id"] in same)
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
        docs = out


LONG = "a passage of some length that differs from every other text by subject words such as {} and {} and is told in full"


def test_near_copies_without_id_or_with_a_shared_id(spark, make_docs):
    """One row of a group stays, whatever its id; an id of two texts loses neither by the other."""
    one, two, three, four = (" ".join(LONG.format(f"{a}{k}", f"{b}{k}") for k in range(6)) for a, b in (("tin", "ore"), ("bay", "gull"), ("loom", "yarn"), ("star", "lens")))
    rows = make_docs([(5, one), (None, one), (7, one), (9, two), (9, three), (11, two), (None, four), (None, four), (12, "x"), (12, "x")], extra=False)
    got = sorted(((r["doc_id"], r["text"]) for r in C.simhash_stage(spark, rows, SF0001).collect()), key=str)
    assert got == sorted([(5, one), (9, two), (9, three), (None, four), (12, "x")], key=str)
    assert C.simhash_stage(spark, make_docs([]), SF0001).collect() == []


def test_contaminated_rows_go_with_or_without_id(spark, make_docs):
    from tidemark.llm.common import table
    item = max((r["text"] for r in table(spark, SF0001, "benchmark").collect() if r["text"]), key=len)
    clean = LONG.format("tin", "ore")
    rows = make_docs([(1, item), (None, item), (2, clean), (1, clean), (None, clean), (3, None)], extra=False)
    got = sorted(((r["doc_id"], r["text"]) for r in C.decontamination_stage(spark, rows, SF0001).collect()), key=str)
    assert got == sorted([(2, clean), (1, clean), (None, clean), (3, None)], key=str)


def test_secrets_of_rows_without_id_and_of_one_hot_source(spark, make_docs):
    """A value in very many documents of one source is a copied example; all the same it is reported and blotted out."""
    line = "password = hunter2hunter2"
    rows = make_docs([(k, f"text {k} {line}", "en", "hot") for k in range(80)] + [(None, f"no id {line}", "en", "hot"), (None, f"no id {line}", "en", "b")], extra=False)
    got = C.secrets_stage(spark, rows, SF0001).collect()
    assert len(got) == 82 and not any("hunter2" in r["text"] for r in got) and all(len(r["text"]) == r["n_chars"] for r in got)


def test_run_on_whole_table(spark):
    got = C.run(spark, SF0001)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
