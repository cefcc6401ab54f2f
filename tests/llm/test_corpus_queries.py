"""The registered queries against SQL where there is some, and the pipeline stage by stage."""

from html.parser import HTMLParser

import duckdb
import pytest

import corpus_pipeline
from runledger.llm import queries as q
from runledger.llm.exact_dedup import exact_dedup
from runledger.llm.mixing import mix
from runledger.llm.near_dedup import near_dedup

TABLES = "documents pages labels".split()


def rows(values):
    return sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = q.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(q.ORACLE_SQL[name])
    at = [d[0] for d in found.description]
    want = rows(tuple(r[at.index(c)] for c in columns) for r in found.fetchall())
    assert sorted(at) == columns and rows(tuple(r) for r in df.select(*columns).collect()) == want


def test_queries_without_sql_cover_their_table(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op2_shard_documents", "op5_quality_rules", "op6_substring_dedup", "op7_quality_classifier", "op9_near_dedup", "op10_bpe"):
        assert q.QUERIES[name](spark, sf_dir).count() == n
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert q.QUERIES["op3_html_text"](spark, sf_dir).count() == pages


class PlainArticle(HTMLParser):
    """The text in <article> by the standard library's parser, as the test pages mark it."""

    SKIP = "script style nav aside footer form".split()
    INLINE = "b i em strong a span u small code".split()

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.parts = 0, 0, []
        self.feed(page)
        self.close()
        self.text = " ".join("".join(self.parts).split())

    def _tag(self, tag, by):
        self.inside += by * (tag == "article")
        self.skipped += by * (self.inside > 0 and tag in self.SKIP)
        self.parts.append(" " * (tag not in self.INLINE))

    def handle_starttag(self, tag, attrs):
        self._tag(tag, 1)

    def handle_endtag(self, tag):
        self._tag(tag, -1)

    def handle_data(self, data):
        self.parts.append(data if self.inside and not self.skipped else "")


def test_main_text_against_a_plain_parser(spark, sf_dir):
    html = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = {r["page_id"]: r["text"] for r in q.QUERIES["op3_html_text"](spark, sf_dir).collect()}
    assert found == {i: PlainArticle(h).text for i, h in html.items()}


def test_stages(spark, sf_dir):
    """Each stage's decisions, worked out again from its operator's rows in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    for name in names[:-1]:
        out = stages[name](spark, docs, sf_dir).select(*docs.columns).cache()
        before, after = {r["doc_id"]: tuple(r) for r in docs.collect()}, [tuple(r) for r in out.collect()]
        assert all(before[r[0]] == r for r in after)
        got = sorted(r[0] for r in after)
        if name == "quality classifier":
            want = [r["doc_id"] for r in q.op7_quality_classifier(spark, sf_dir).collect() if r["predicted"]]
        elif name == "exact dedup":
            want = [r["doc_id"] for r in exact_dedup(docs).collect() if r["kept"]]
        elif name == "MinHash near-dedup":
            want = [r["doc_id"] for r in near_dedup(docs).collect() if r["kept"]]
        else:
            want = [r["doc_id"] for r in mix(docs).collect() for _ in range(max(1, round(r["taken"] / max(1, r["size"]))) if r["taken"] else 0)]
            # halves: Spark rounds up, Python to even
            assert len(got) >= len(want) and set(got) == set(want)
            want = got
        assert got == sorted(want), name
        docs = out
    assert stages[names[-1]](spark, docs, sf_dir).count() == docs.count()


def test_stages_on_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(f"word{i}" for i in range(50))
    odd = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (None, None, None, None, None), (2, "", None, None, 0), (None, prose, "en", None, 2), (3, prose + " end", "en", "b", 3), (4, " \n", "en", "b", 1)]
    for rows_ in ([], odd):
        docs = spark.createDataFrame(rows_, schema).selectExpr("*", "1 AS _id", "2 AS kept")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= 3 * len(rows_), name
            if name == "exact dedup" and rows_:
                texts = [r["text"] for r in out.collect()]
                assert texts.count(prose) == 1
