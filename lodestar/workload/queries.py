"""The registered queries. Each runs over its whole tables and returns flat columns.

Scores are rounded to 6 decimals and statistics to 4, after all comparing and ranking is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions.stopwords import ENGLISH
from lodestar.operators import answers as an
from lodestar.operators import context as cx
from lodestar.operators import corpus as co
from lodestar.operators import index as ix
from lodestar.operators import profile as pr
from lodestar.operators import ranking as rk
from lodestar.operators.urls import first_occurrences, numbered
from lodestar.plans import ask as plan
from lodestar.plans.study import StudyTable, table_profiles
from lodestar.session import fresh_path
from lodestar.settings import FILES_PER_DATASET, HEAD_CHARS, IndexSettings
from lodestar.sources import catalog as ct
from lodestar.sources.delimited import read_delimited as read_files
from lodestar.sources.export import data_link, json_text
from lodestar.workload.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SCORES = ("score", "sim", "overlap", "boost", "weight", "idf")
STATS = ("mean", "median", "std", "min", "max", "pct", "num")


def query(job: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    REGISTRY[job.__name__] = lambda spark, folder: job(Tables(spark, folder))
    return job


def shown(df: DataFrame) -> DataFrame:
    """Rounded scores and statistics, whole numbers as BIGINT."""

    def field(name: str, kind: str) -> Column:
        if name in SCORES:
            return F.round(name, 6).alias(name)
        if name in STATS:
            return F.round(name, 4).alias(name)
        return F.col(name).cast("long").alias(name) if kind in ("int", "bigint") else F.col(name)

    return df.select(*[field(name, kind) for name, kind in df.dtypes])


# Sources and sinks


def _json_catalog(t: Tables) -> DataFrame:
    """Per part a catalogue of one dataset as JSON; every third has an empty list of assays."""
    assays = F.when(F.col("p_size") % 3 == 0, F.lit("[]")).otherwise(
        F.concat(F.lit('["'), F.col("p_type"), F.lit('/a1.txt","a2.txt"]'))
    )
    json = F.format_string(
        '{"part-%d": {"organism": "%s", "assay_types": ["%s"], "folder": "f/%d", "files": '
        '{"investigation": "i/%d.txt", "samples": "s/%d.txt", "assays": %s, "extra": "x.txt", "fifth": "y.txt"}, '
        '"description": "%s"}}',
        "p_partkey", "p_brand", "p_type", "p_size", "p_partkey", "p_partkey", assays, "p_name",
    )
    return ct.parse_catalog(t.read("part").select("p_partkey", json.alias("json")), "json", ["p_partkey"])


@query
def catalog_entries(t: Tables) -> DataFrame:
    return shown(
        _json_catalog(t).select(
            "dataset", "pos", "organism", F.array_join("assay_types", "|").alias("assay_types"), "folder", "description",
            F.size("files").alias("n_files"),
        )
    )


@query
def publication_entries(t: Tables) -> DataFrame:
    entry = F.to_json(F.array(F.struct(F.col("title").alias("Title"), F.col("link").alias("Link"))))
    only_link = F.to_json(F.array(F.struct(F.col("link").alias("Link"))))
    texts = t.publications().select("pos", F.posexplode(F.array(entry, only_link)).alias("part", "json"))
    return ct.parse_publications(texts, "json", ["pos", "part"])


@query
def catalog_files(t: Tables) -> DataFrame:
    """The first files of every dataset."""
    return ct.catalog_files(_json_catalog(t), FILES_PER_DATASET)


@query
def all_catalog_files(t: Tables) -> DataFrame:
    return ct.catalog_files(_json_catalog(t))


@query
def missing_files(t: Tables) -> DataFrame:
    present = t.read("part").where(F.col("p_size") > 10).select(F.format_string("s/%d.txt", "p_partkey").alias("path"))
    return ct.mark_missing(ct.catalog_files(_json_catalog(t), FILES_PER_DATASET), present)


@query
def read_delimited(t: Tables) -> DataFrame:
    """Events written as tab-separated files, read back as cells; how often each value occurs."""
    path = fresh_path(t.spark, "events-tsv")
    events = t.read("events").withColumn("ts", F.col("ts").cast("string"))
    events.write.options(sep="\t", header=True, quote='"', escape='"').csv(path)
    cells = read_files(t.spark, path, multi_line=False)
    return shown(cells.groupBy("column", "value").agg(F.count("*").alias("n")))


@query
def read_quoted_delimited(t: Tables) -> DataFrame:
    """Documents written as CSV files with quoted line breaks, commas, quotes and the header ``text`` twice, read back
    by the default (splittable) reader; per column its rows, filled cells, distinct values, characters and extremes."""
    path = fresh_path(t.spark, "documents-csv")
    docs = t.read("documents")
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    options = {"quote": '"', "escape": '"', "quoteAll": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    fields = F.struct(F.col("doc_id").cast("string").alias("a"), F.col("text").alias("b"), F.col("text").alias("c"), F.col("lang").alias("d"))
    lines = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"), F.lit(1).alias("kind"), F.to_csv(fields, options).alias("value"))
    # Every file begins with its header: one header row per part, which goes first in the part's only task.
    headers = t.spark.range(parts).select(F.col("id").alias("part"), F.lit(0).alias("kind"), F.lit("doc_id,text,text,lang").alias("value"))
    table = lines.unionByName(headers).repartition(parts, "part").sortWithinPartitions("part", "kind")
    table.drop("kind").write.partitionBy("part").text(path)
    cells = read_files(t.spark, path)
    sums = cells.groupBy("column").agg(
        F.count("*").alias("n"),
        F.count("value").alias("filled"),
        F.sum(F.length("value")).alias("chars"),
        F.min("value").alias("first_value"),
        F.max("value").alias("last_value"),
    )
    # Values are told apart by their SHA-256, so that no text is shuffled to count them.
    told_apart = cells.groupBy("column").agg(F.count_distinct(F.sha2(F.col("value").cast("binary"), 256)).alias("distinct_values"))
    same = sums["column"].eqNullSafe(told_apart["column"])
    return sums.join(told_apart.hint("broadcast"), same).select(sums["column"], "n", "filled", "distinct_values", "chars", "first_value", "last_value")


@query
def preview_rows(t: Tables) -> DataFrame:
    rows = cx.first_rows(t.read("events"), ["event_type"], ["event_id"])
    return shown(rows.select("event_type", "row_pos", "event_id", "user_id", "value"))


@query
def raw_text_head(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", tx.head(F.col("text"), HEAD_CHARS).alias("head"))


@query
def null_tokens(t: Tables) -> DataFrame:
    tokens = F.array(*[F.lit(token) for token in tx.MISSING_TOKENS])
    value = F.coalesce(F.get(tokens, F.pmod("l_orderkey", F.lit(40)).cast("int")), F.col("l_linestatus"))
    cells = t.read("lineitem").select("l_returnflag", tx.null_missing(value).alias("value"))
    return cells.groupBy("l_returnflag", "value").agg(F.count("*").alias("n"))


@query
def result_json(t: Tables) -> DataFrame:
    hits = shown(rk.search(t.index(), t.questions()).select("query_id", "entry_type", "rank", "key", "score"))
    json = json_text(F.struct("query_id", "entry_type", "rank", "key", F.format_string("%.6f", "score").alias("score")))
    return hits.select("query_id", "entry_type", "rank", json.alias("json"), data_link(json).alias("link"))


# Text


def _linked_text() -> Column:
    url = F.col("url")
    return F.concat(F.lit("see ("), url, F.lit("), "), F.upper(url), F.lit('; "'), url, F.lit('" <'), url, F.lit("/a,b.:> "), F.col("html"))


@query
def extract_urls(t: Tables) -> DataFrame:
    pages = t.read("pages").select("page_id", F.inline(numbered(tx.extract_urls(_linked_text()))))
    return shown(pages)


@query
def dedup_urls(t: Tables) -> DataFrame:
    """First page and place of every link, per language of the page."""
    lang = F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang")
    urls = tx.extract_urls(F.concat(_linked_text(), F.lit(" http://"), lang, F.lit(".example/ ")))
    found = t.read("pages").select(lang, F.inline(numbered(urls, F.col("page_id"))))
    firsts = first_occurrences(found, "lang", ["page_id", "pos"])
    return shown(firsts.select("lang", "url", "place.page_id", "place.pos"))


@query
def word_tokens(t: Tables) -> DataFrame:
    tokens = t.read("documents").select("doc_id", tx.word_tokens(F.col("text")).alias("tokens"))
    return shown(tokens.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens")))


@query
def number_tokens(t: Tables) -> DataFrame:
    tokens = t.read("documents").select("doc_id", tx.number_tokens(F.col("text")).alias("tokens"))
    return shown(tokens.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens")))


def _label_parts(t: Tables) -> DataFrame:
    """Labels of a document as its only file: names and first rows as text."""
    dataset = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("dataset")
    values = [("quality", 0), ("toxic", 1)]
    cell = [F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c, i in values]
    cells = t.read("labels").select(dataset.alias("path"), F.lit(0).alias("row_pos"), F.inline(F.array(*cell)))
    texts = co.sample_texts(cells)
    files = t.read("labels").select(dataset, F.lit(0).alias("file_pos"), dataset.alias("path")).distinct()
    return co.file_parts(files, texts)


@query
def dataset_text(t: Tables) -> DataFrame:
    return co.dataset_texts(t.catalog(), _label_parts(t)).select("dataset", "text")


@query
def dataset_text_urls(t: Tables) -> DataFrame:
    pages = t.read("pages").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("dataset"),
        F.col("html").alias("organism"),
        F.concat(F.lit("at "), "url", F.lit(", and "), "url", F.lit("#b.")).alias("description"),
        F.concat("url", F.lit("/folder;")).alias("folder"),
    )
    urls = co.dataset_text_urls(pages)
    return urls.select("dataset", F.array_join("urls", " ").alias("urls"))


@query
def publication_text(t: Tables) -> DataFrame:
    pubs = t.publications()
    return pubs.select(
        F.concat(F.lit("pub_"), F.col("pos").cast("string")).alias("key"),
        co.publication_text(F.col("title"), F.col("link")).alias("text"),
    )


@query
def clean_answers(t: Tables) -> DataFrame:
    text = F.concat(
        F.lit("\t "), "text", F.lit("\nas an AI Language model I cannot\nsay.  End  of"), F.lit("\x01\x02turn "),
        F.col("turn").cast("string"), F.lit(" As an ai language model"),
    )
    turns = t.read("conversations").where(F.col("role") == "assistant")
    return turns.select("conv_id", "turn", tx.clean_answer(text).alias("answer"))


@query
def parse_answers(t: Tables) -> DataFrame:
    turns = t.read("conversations").where(F.col("role") == "assistant")
    links = t.read("pages").select(F.col("page_id").alias("conv_id"), "url")
    content = F.when(F.col("turn") == 3, F.lit("")).otherwise(F.concat_ws(" ", "text", "url", "url"))
    given = turns.join(links, "conv_id", "left").select(
        F.struct("conv_id", "turn").alias("query_id"),
        content.alias("content"),
        F.when(F.col("turn") > 1, F.lit("batch")).alias("model"),
        F.length("text").alias("usage"),
    )
    parsed = an.parse_answers(given)
    return shown(parsed.select("query_id.*", "content", F.array_join("urls", " ").alias("urls"), "model", "usage"))


@query
def local_summary(t: Tables) -> DataFrame:
    """A summary of every document, with the page of the same number as its publication."""
    pages = t.publications().select(F.col("pos").alias("doc_id"), F.array(F.struct("title", "link")).alias("papers"))
    asked = F.concat(F.lit("Any Gene in "), "source", F.lit("?"))
    docs = t.read("documents").join(pages, "doc_id", "left").withColumn("shown", an.summary_lines(F.col("text")))
    none = F.array().cast("array<struct<title:string,link:string>>")
    papers = F.coalesce("papers", none)
    urls = F.transform(papers, lambda p: p["link"])
    return docs.select("doc_id", an.summary(asked, F.col("shown"), papers, urls).alias("summary"))


@query
def suggest_searches(t: Tables) -> DataFrame:
    words = F.array(F.lit("MicroGravity"), F.lit("gene data"), F.lit("NASA"), F.lit("spaceflight"))
    question = F.concat_ws(" ", "text", F.get(words, F.pmod("turn", F.lit(5)).cast("int")))
    return t.read("conversations").select(
        "conv_id", "turn", F.array_join(an.suggestions(question), "|").alias("suggestions")
    )


@query
def candidate_list(t: Tables) -> DataFrame:
    hits = _all_hits(t)
    return shown(rk.candidate_list(hits.datasets, hits.publications))


# Index


@query
def corpus(t: Tables) -> DataFrame:
    return t.corpus()


@query
def index_counts(t: Tables) -> DataFrame:
    return co.index_counts(t.corpus())


@query
def terms(t: Tables) -> DataFrame:
    """Per entry its number of terms and a digest of their sequence."""
    tokens = ix.by_entry(t.corpus()).select("ord", tx.kept_tokens(F.col("text"), IndexSettings().stop_words).alias("tokens"))
    listed = tokens.select("ord", tx.with_bigrams(F.col("tokens")).alias("terms"))
    return shown(listed.select("ord", F.size("terms").alias("n"), F.md5(F.array_join("terms", "|").cast("binary")).alias("digest")))


@query
def term_freq(t: Tables) -> DataFrame:
    return ix.term_frequencies(ix.by_entry(t.corpus()), "ord", IndexSettings())


@query
def vocabulary(t: Tables) -> DataFrame:
    return ix.vocabulary(t.corpus(), IndexSettings()).select("term", "df", "total")


@query
def idf(t: Tables) -> DataFrame:
    return shown(ix.vocabulary(t.corpus(), IndexSettings()).select("term", "idf"))


@query
def tfidf_weights(t: Tables) -> DataFrame:
    return shown(t.index().terms)


@query
def query_weights(t: Tables) -> DataFrame:
    return shown(rk.query_weights(t.questions(), t.index()))


@query
def index_roundtrip(t: Tables) -> DataFrame:
    """Hits found with an index of few stop words and terms that was written and read again."""
    path = fresh_path(t.spark, "index")
    ix.write_index(t.index(IndexSettings(ENGLISH[:40], 500)), path)
    return _hits(rk.search(ix.read_index(t.spark, path), t.questions()))


# Ranking


def _hits(hits: DataFrame) -> DataFrame:
    return shown(hits.select("query_id", "entry_type", "rank", "key", "score", "sim", "overlap"))


@query
def cosine_sim(t: Tables) -> DataFrame:
    return shown(rk.cosine_similarities(t.index(), t.questions()))


@query
def token_overlap(t: Tables) -> DataFrame:
    return shown(rk.token_overlaps(t.index(IndexSettings(max_features=0)), t.questions()))


@query
def number_boost(t: Tables) -> DataFrame:
    return shown(rk.number_boosts(t.index(IndexSettings(max_features=0)), t.questions()))


@query
def blended_score(t: Tables) -> DataFrame:
    return shown(rk.score_pairs(t.index(), t.questions()))


@query
def search(t: Tables) -> DataFrame:
    return _hits(rk.search(t.index(), t.questions()))


@query
def search_parsed_catalog(t: Tables) -> DataFrame:
    """Hits in a catalogue that is spread over many JSON texts."""
    fields = F.struct("organism", "assay_types", "folder", "description")
    texts = t.catalog().select("pos", F.to_json(F.create_map("dataset", fields)).alias("json"))
    papers = t.publications().select("pos", F.to_json(F.array(F.struct(F.col("title").alias("Title"), F.col("link").alias("Link")))).alias("json"))
    catalog, publications = ct.parse_catalog(texts, "json", ["pos"]), ct.parse_publications(papers, "json", ["pos"])
    return _hits(rk.search(ix.build_index(co.build_corpus(co.dataset_texts(catalog), publications)), t.questions()))


@query
def rank_no_vocab(t: Tables) -> DataFrame:
    return _hits(rk.search(t.index(IndexSettings(max_features=0)), t.questions()))


@query
def search_publications(t: Tables) -> DataFrame:
    hits = _all_hits(t).publications
    return shown(hits.select("query_id", "rank", "title", "link", "score", "sim", "overlap"))


@query
def search_datasets(t: Tables) -> DataFrame:
    hits = _all_hits(t).datasets
    return shown(hits.select("query_id", "rank", "key", "organism", F.array_join("assay_types", " ").alias("assay_types"), "description", "score"))


# Profiles


def _text_cells(t: Tables) -> DataFrame:
    """Every value of several tables as text, as read from a file without types."""

    def cells(name: str, extra: dict[str, Column]) -> DataFrame:
        df = t.read(name).withColumns(extra)
        pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns]
        return df.select(F.lit(name).alias("dataset"), F.inline(F.array(*pairs)))

    odd = F.col("c_custkey") % 2 == 1
    customer = {
        "flag": odd,
        "flag_or_none": F.when(F.col("c_custkey") % 5 > 0, odd),
        "mixed": F.when(F.col("c_custkey") % 7 == 0, F.lit("1d")).otherwise(F.col("c_custkey").cast("string")),
        "spread": F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(".0")),
        "nothing": F.lit(None).cast("string"),
    }
    parts = [cells("customer", customer), cells("orders", {}), cells("events", {}), cells("part", {})]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def detect_numeric(t: Tables) -> DataFrame:
    raw = _text_cells(t).groupBy("dataset", "column", F.col("value").alias("raw")).agg(F.count("*").alias("n"))
    kinds = pr.column_kinds(raw, ["dataset", "column"])
    return kinds.select("dataset", "column", (F.col("kind") != pr.TEXT).alias("numeric"))


@query
def profile_counts(t: Tables) -> DataFrame:
    keys = ["dataset", "column"]
    f = pr.ranged(pr.text_frequencies(_text_cells(t), keys), keys)
    return shown(pr.counts(f).select(*keys, "count", "unique"))


def _frequencies(t: Tables, name: str) -> pr.Frequencies:
    return pr.ranged(pr.frequencies(pr.frame_cells(t.read(name)), ["col_pos"]), ["col_pos"])


@query
def profile_numeric(t: Tables) -> DataFrame:
    return shown(pr.numeric_stats(_frequencies(t, "lineitem")))


@query
def profile_top_values(t: Tables) -> DataFrame:
    return shown(pr.top_values(_frequencies(t, "lineitem")).select("col_pos", "rank", "value", "num", "count", "pct"))


@query
def profile_large_ids(t: Tables) -> DataFrame:
    """Counts and top values of ids that doubles can't tell apart, as numbers and as text."""
    large = F.col("event_id") % 1000 + F.lit(1 << 53)
    events = t.read("events").select(large.alias("id"), large.cast("string").alias("txt"))
    typed = pr.ranged(pr.frequencies(pr.frame_cells(events.select("id")), ["col_pos"]), ["col_pos"])
    cells = events.select(F.lit(1).cast("long").alias("col_pos"), F.col("txt").alias("value"))
    text = pr.ranged(pr.text_frequencies(cells, ["col_pos"]), ["col_pos"])

    def listed(f: pr.Frequencies) -> DataFrame:
        return pr.top_values(f).join(pr.counts(f).select("col_pos", "unique"), "col_pos").select("col_pos", "rank", "value", "count", "unique")

    return shown(listed(typed).unionByName(listed(text)))


@query
def profile_empty(t: Tables) -> DataFrame:
    """Labels of each quality, where one column has values in one group only."""
    values = F.struct(F.lit("toxic").alias("column"), F.col("toxic").cast("string").alias("value"))
    only_good = F.struct(F.lit("good").alias("column"), F.when(F.col("quality") == 1, F.lit("yes")).alias("value"))
    cells = t.read("labels").select(F.col("quality").cast("string").alias("dataset"), F.inline(F.array(values, only_good)))
    columns = cells.select("dataset", "column").distinct()
    records = pr.profile_cells(cells, ["dataset", "column"], columns)
    return shown(records.select("dataset", "column", "note", "count"))


def _flat(records: DataFrame) -> DataFrame:
    """Profile records with the top values as one text."""
    top = F.transform("top", lambda v: F.concat(v["value"], F.lit("="), v["count"].cast("string")))
    return shown(records.withColumn("top", F.array_join(top, "; ")))


@query
def profile_table(t: Tables) -> DataFrame:
    return _flat(pr.profile_frame(t.read("lineitem"))).drop("note")


@query
def profile_merge(t: Tables) -> DataFrame:
    """Orders and line items as files of one dataset per status; shared names keep the last file."""
    orders = t.read("orders").select(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")
    )
    items = t.read("lineitem").select(
        F.col("l_linestatus").alias("dataset"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")
    )
    records = table_profiles([StudyTable(0, "orders", orders, ["key"]), StudyTable(1, "items", items, ["price"])])
    merged = pr.merge_files(records)
    return shown(
        merged.select("dataset", "column", "place.file_pos", "place.col_pos", "summary.count", "summary.unique", "summary.median")
    )


@query
def render_columns(t: Tables) -> DataFrame:
    records = pr.profile_frame(t.read("lineitem"))
    return records.select("col_pos", pr.rendered().alias("line"))


# Contexts and answers


@query
def preview_block(t: Tables) -> DataFrame:
    customers = t.read("customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment")
    rows = cx.first_rows(customers, ["c_nationkey"], ["c_custkey"])
    texts = cx.preview_texts(rows, ["c_nationkey"], ["c_custkey", "c_name", "c_mktsegment"])
    return shown(texts)


@query
def top_value_urls(t: Tables) -> DataFrame:
    """Links among the most frequent values of the pages of each language."""
    lang = F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("dataset")
    pages = t.read("pages").select(lang, F.concat(F.lit("<"), "url", F.lit(">")).alias("where"), F.regexp_extract("url", "^https?://[^/]+", 0).alias("site"))
    table = StudyTable(0, "pages", pages, ["where"])
    study = cx.StudyFiles(t.spark.createDataFrame([], "dataset STRING"), t.spark.createDataFrame([], "dataset STRING"), table_profiles([table]))
    catalog = pages.select("dataset").distinct().withColumn("description", F.lit(None).cast("string"))
    firsts = cx.context_urls(catalog, study)
    return shown(firsts.select("dataset", "url", "place.col_pos", "place.rank", "place.pos"))


def _context_row(df: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("columns", lambda c: F.concat(c["column"], F.lit("="), c["summary"]["count"].cast("string"))), " ")
    return df.select("dataset", "context", F.array_join("urls", " ").alias("urls"), names.alias("columns"))


@query
def dataset_context(t: Tables) -> DataFrame:
    return _context_row(cx.dataset_contexts(t.warehouse_catalog(), t.warehouse_study()))


@query
def dataset_details(t: Tables) -> DataFrame:
    return _context_row(cx.dataset_details(t.warehouse_catalog(), "web", t.warehouse_study("web")))


def _all_hits(t: Tables) -> plan.Hits:
    return plan.hits_of(t.index(), t.questions(), t.catalog(), t.publications())


@query
def combined_context(t: Tables) -> DataFrame:
    hits = _all_hits(t)
    contexts = plan.contexts_of_hits(hits, t.catalog(), t.label_study)
    return cx.combined_contexts(t.questions(), hits.datasets, hits.publications, contexts)


@query
def prompt_table(t: Tables) -> DataFrame:
    return plan.prompt_table(t.questions(), REGISTRY["combined_context"](t.spark, t.folder))


@query
def recommended_urls(t: Tables) -> DataFrame:
    """Links of hits and answers, with the answer's links first."""
    catalog = t.catalog().withColumn("description", F.concat("description", F.lit(" http://docs.example/"), "organism"))
    hits = plan.hits_of(t.index(), t.questions(), catalog, t.publications())
    contexts = plan.contexts_of_hits(hits, catalog, None)
    given = an.parse_answers(t.answers())
    urls = an.recommended_urls(hits.datasets, hits.publications, contexts, given, datasets_first=False)
    return shown(urls.select("query_id", "url", "place.source", "place.rank", "place.pos"))


@query
def ask_batch(t: Tables) -> DataFrame:
    records = plan.ask(t.index(), t.questions(), t.catalog(), t.publications(), t.answers(), t.label_study)

    def listed(name: str, label: str) -> Column:
        return F.array_join(F.transform(name, lambda h: F.concat(h[label], F.lit(":"), F.format_string("%.4f", F.round(h["score"], 4)))), " ")

    structured = F.array_join(
        F.transform("structured", lambda s: F.concat(s["dataset"], F.lit(":"), F.coalesce(F.size(F.coalesce(s["columns"], F.array())), F.lit(0)).cast("string"))), " "
    )
    return shown(
        records.select(
            "query_id",
            "answer",
            F.array_join("recommended_urls", " ").alias("recommended_urls"),
            listed("used_datasets", "dataset").alias("used_datasets"),
            listed("used_publications", "link").alias("used_publications"),
            "meta.fallback",
            "meta.model",
            "meta.usage",
            structured.alias("structured"),
        )
    )


@query
def metadata_bundle(t: Tables) -> DataFrame:
    """What the bundle of every answer says, read from its JSON, and whether the link holds the same."""
    records = plan.ask(t.index(), t.questions(), t.catalog(), t.publications(), t.answers(), t.label_study)
    bundles = plan.metadata_bundles(records)
    held = F.decode(F.unbase64(F.substring_index("link", ",", -1)), "UTF-8")

    def at(path: str) -> Column:
        return F.get_json_object("bundle", path)

    return bundles.select(
        "query_id",
        at("$.meta.fallback").cast("boolean").alias("fallback"),
        at("$.meta.usage").cast("long").alias("usage"),
        at("$.used_datasets[0].dataset").alias("dataset"),
        at("$.used_publications[0].link").alias("publication"),
        at("$.structured[0].dataset").alias("structured"),
        (held == F.col("bundle")).alias("same"),
    )
