"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Every text is read for its stretches: tokens with a digit or @, which all that is looked for has, with the two words
before them. All else is done in stretches. Matches of the base patterns and all tokens (possible identifiers, with the
two words before them) become rows; their places are running sums of what lies between them and between stretches.
Valid base matches, also those of several words, and tokens of a known form are seeds. The two words before the word that
a token is, or that a base match begins in, are its pattern: patterns and values make a graph, without tokens that are a
part of a base match or around one. In each round a pattern's confidence is the share of its values that are believed, and
a value is believed by what its patterns say together. Tokens of confident patterns are identifiers too, though no base
pattern knows their form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.words import documents, free_name
from lodestar.session import written

#: In the order of results; the last one has no base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")

# The contract's patterns. A run is entered at its beginning only and never given back, which finds the same matches
# in linear time; an e-mail address may also begin where the one before ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]++"
#: Before a word; not between the halves of a character beyond U+FFFF.
_BEGIN = rf"(?<!{_WORD})(?![\x{{DC00}}-\x{{DFFF}}])"
#: A token, from the beginning of its word on; a word that is none, with the gap behind it.
_TOKEN, _PLAIN = rf"[^\x20\x09-\x0D0-9@]*+[0-9@]{_WORD}*+", rf"[^\x20\x09-\x0D0-9@]++{_GAP}"
#: What lies between tokens, and a token.
_GAP_AND_TOKEN = rf"\G((?:[^0-9@]*[\x20\x09-\x0D])?+)({_TOKEN})"
#: Nothing, at the first of two words before a token; the two words.
_BEFORE_TOKEN = rf"{_BEGIN}(?=({_WORD}++{_GAP}{_WORD}++){_GAP}[^\x20\x09-\x0D0-9@]*+[0-9@])"
#: What lies before a stretch; the stretch: two words, a token, and further tokens as long as no more than two words lie
#: between them, or words of what may stand between the digits of a phone number. All tokens and matches of base patterns
#: lie in stretches, with the two words before them and all that tells where they begin and end.
_STRETCH = (
    rf"\G(?=[^0-9@]*+[0-9@])([^0-9@]*{_BEGIN}(?=(?:{_PLAIN}){{2}}+[^\x20\x09-\x0D0-9@]*+[0-9@])|[\x20\x09-\x0D]*+)"
    rf"((?:{_PLAIN}){{0,2}}+{_TOKEN}(?:{_GAP}(?:[().-]++{_GAP})*+(?:{_PLAIN}){{0,2}}+{_TOKEN})*+)"
)
_TOKEN_KIND, _NONE = len(KINDS), -1
#: Kinds from here on, less this, are of base matches that seed the pattern in ``left``; they have no place.
_SEED_KIND = 10

# Marks around the valid matches of a copy of the text; the text's own ones are replaced.
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\ufffd"
#: What every valid match has in it, which is found faster.
_NEEDED = ("@", r"[0-9]\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){12}", r"\+[0-9]")
#: Nothing, at the first of two words before a word in which valid matches begin; the two words and the matches.
_BEFORE_MATCH = (
    rf"{_BEGIN}(?=({_WORD}++{_GAP}{_WORD}++){_GAP}"
    rf"([^\x20\x09-\x0D\x01]*+(?=\x01)(?:\x01[^\x20\x09-\x0D\x02]*+\x02[^\x20\x09-\x0D\x01]*+)*+(?:\x01[^\x02]*+\x02)?+))"
)

#: Forms of a whole token that are seeds beside the base patterns: long keys of hexadecimal digits.
_SECRET = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"


@dataclass(frozen=True)
class Bootstrap:
    """A pattern counts from ``support`` believed values on; it is confident from ``confidence`` on."""

    rounds: int = 3
    support: int = 3
    confidence: float = 0.8


def stretches(text: Column) -> Column:
    """``_STRETCH`` all over a text: each with the length of what lies between it and the one before; an empty one if there is none."""
    none = F.array(F.struct(F.lit(0).alias("skipped"), F.lit("").alias("words")))
    skipped, words = (F.regexp_extract_all(text, F.lit(_STRETCH), F.lit(i)) for i in (1, 2))
    found = F.zip_with(skipped, words, lambda x, y: F.struct(F.length(x).alias("skipped"), y.alias("words")))
    return F.when(text.rlike("[0-9@]"), found).otherwise(none)


def _entry(kind: int, place: Column, gap: Column, value: Column, left: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), place.alias("place"), gap.alias("gap"), value.alias("value"), left.alias("left"))


def _or_none(entries: Column) -> Column:
    return F.coalesce(entries, F.array().cast("array<struct<kind:int,place:int,gap:int,value:string,left:string>>"))


def _pieces(text: Column, kind: int) -> Column:
    """The text cut behind every match of a base pattern, with a mark before the match; null if it can have no valid one."""
    shown = F.translate(text, _OPEN + _CLOSE, _OTHER * 2)
    return F.when(text.rlike(_NEEDED[kind]), F.split(F.regexp_replace(shown, PATTERNS[kind], f"{_OPEN}$0{_CLOSE}"), _CLOSE, -1))


def _has_match(piece: Column) -> Column:
    return F.contains(piece, F.lit(_OPEN))


def _match(piece: Column) -> Column:
    return F.substring_index(piece, _OPEN, -1)


def _entries(pieces: Column, kind: int) -> Column:
    """Matches in order, each with the length of what lies between it and the one before."""
    return _or_none(
        F.transform(F.filter(pieces, _has_match), lambda p, i: _entry(kind, i, F.length(F.substring_index(p, _OPEN, 1)), _match(p), F.lit("")))
    )


def _token_entries(text: Column) -> Column:
    """Tokens in order, as ``_entries``, with the two words before each."""
    gaps, values = (F.regexp_extract_all(text, F.lit(_GAP_AND_TOKEN), F.lit(i)) for i in (1, 2))
    before = F.regexp_extract_all(text, F.lit(_BEFORE_TOKEN), F.lit(1))
    # Those with fewer words before them are the first ones.
    left = F.concat(F.array_repeat(F.lit(""), F.size(values) - F.size(before)), before)
    found = F.arrays_zip(gaps.alias("gap"), values.alias("value"), left.alias("left"))
    return F.transform(found, lambda x, i: _entry(_TOKEN_KIND, i, F.length(x["gap"]), x["value"], x["left"]))


def _marked(pieces: Column, kind: int) -> Column:
    """The pieces joined, with marks around the valid matches of the base pattern."""
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(~_has_match(p), p)
            .when(valid(F.lit(kind), _match(p)), F.concat(p, F.lit(_CLOSE)))
            .otherwise(F.translate(p, _OPEN, "")),
        ),
        "",
    )


def _seeds(marked: Column, kind: int) -> Column:
    """Marked matches with the two words before the word that each begins in, as entries without a place."""
    marked = F.when(F.contains(marked, F.lit(_OPEN)), marked)
    before, begun = (F.regexp_extract_all(marked, F.lit(_BEFORE_MATCH), F.lit(i)) for i in (1, 2))
    given = F.zip_with(
        before,
        begun,
        lambda left, words: F.transform(
            F.regexp_extract_all(words, F.lit("\x01([^\x02]*+)\x02"), F.lit(1)),
            lambda value: F.struct(value.alias("value"), F.translate(left, _OPEN + _CLOSE, "").alias("left")),
        ),
    )
    return _or_none(F.transform(F.flatten(given), lambda x, i: _entry(_SEED_KIND + kind, i, F.lit(0), x["value"], x["left"])))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, kind, start, end, value, left`` of all tokens and matches, and a row of kind -1 for every document.

    Rows of ``_SEED_KIND`` and above are valid base matches once more, with the two words before them. Matches are left
    out where a stretch can have no valid one of their kind.
    """
    texts = documents(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    parts = texts.select("doc_id", "text_hash", F.posexplode(stretches(F.col("text"))).alias("stretch", "s")).select(
        "doc_id", "text_hash", "stretch", "s.*", F.length("s.words").alias("size")
    )
    kinds, words = range(len(PATTERNS)), F.col("words")
    parts = parts.withColumns({f"pieces_{k}": _pieces(words, k) for k in kinds})
    parts = parts.withColumns({f"marked_{k}": _marked(F.col(f"pieces_{k}"), k) for k in kinds})
    none = F.when(F.col("stretch") == 0, F.array(_entry(_NONE, F.lit(0), F.lit(0), F.lit(""), F.lit(""))))
    entries = [*[_entries(F.col(f"pieces_{k}"), k) for k in kinds], _token_entries(words)]
    seeds = [_seeds(F.col(f"marked_{k}"), k) for k in kinds]
    rows = parts.select(
        "doc_id", "text_hash", "stretch", "skipped", "size", F.explode(F.concat(_or_none(none), *entries, *seeds)).alias("m")
    )
    doc = ["doc_id", "text_hash"]
    # Repeated rows give the same matches, which count once.
    once = rows.select(*doc, "stretch", "skipped", "size", "m.*").dropDuplicates([*doc, "stretch", "kind", "place"]).repartition(*doc)
    # Every stretch has a first token, and no place in a stretch is known but by the sizes of those before it.
    moved = F.when((F.col("kind") == _TOKEN_KIND) & (F.col("place") == 0), F.col("skipped") + F.col("size"))
    before = Window.partitionBy(*doc).orderBy("stretch").rangeBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*doc, "stretch", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.when(F.col("kind") == _NONE, 0).otherwise(F.col("skipped")) + F.sum(F.col("gap") + F.length("value")).over(so_far)
    placed = once.withColumn("end", end).withColumn("end", F.col("end") + F.coalesce(F.sum(moved).over(before), F.lit(0)))
    return placed.select(*doc, "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "left")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass; every second one from the right is doubled, less 9 above 9."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.cast("int"), F.lit(0)))
    total = F.aggregate(
        F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)), F.lit(0), lambda a, v: a + v
    )
    return total % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern passes the checks of its kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, value.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == 2, F.length(digits).between(13, 19) & _luhn(digits))
        .when(kind == 3, F.length(digits).between(9, 15))
        .otherwise(F.lit(False))
    )


def _pattern(before: Column) -> Column:
    """Two words lower-cased, each digit as 0; null for an empty text."""
    pattern = F.regexp_replace(F.regexp_replace(F.lower(before), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " ")
    return F.when(pattern != "", pattern)


def tokens(found: DataFrame) -> DataFrame:
    """Possible identifiers without the marks around them: ``doc_id, text_hash, start, end, value, pattern, seed``.

    ``pattern`` is the two words before, lower-cased, each digit as 0; null with fewer words before.
    """
    value, left = F.col("value"), F.col("left")
    lead = F.length(F.regexp_extract(value, r"^[^A-Za-z0-9+]*", 0))
    core = F.regexp_extract(value, r"^[^A-Za-z0-9+]*(.*?)[^A-Za-z0-9]*$", 1)
    pattern = _pattern(F.translate(left, _OPEN + _CLOSE, _OTHER * 2))
    rows = found.where(F.col("kind") == _TOKEN_KIND).select(
        "doc_id", "text_hash", (F.col("start") + lead).alias("start"), core.alias("value"), pattern.alias("pattern")
    )
    whole = [F.col("value").rlike(f"^(?:{p})$") & valid(F.lit(k), F.col("value")) for k, p in enumerate(PATTERNS)]
    seed = F.coalesce(*[F.when(is_kind, k) for k, is_kind in enumerate([*whole, F.col("value").rlike(_SECRET)])])
    return (
        rows.where(F.length("value") >= 4)
        .withColumn("end", F.col("start") + F.length("value"))
        .withColumn("seed", seed)
        .select("doc_id", "text_hash", "start", "end", "value", "pattern", "seed")
    )


def free_tokens(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``free``: whether no base span reaches into the token from before or begins within it.

    Others than seeds that are not free are left out: parts of a base span are no identifiers of their own.
    """
    doc = ["doc_id", "text_hash"]
    spans = base.where(f"kind <> {_NONE}").select(*doc, "start", "end", "base")
    both = spans.unionByName(candidates.withColumn("base", F.lit(False)), allowMissingColumns=True)
    ahead = Window.partitionBy(*doc).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*doc).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(before)
    next_base = F.min(F.when(F.col("base"), F.col("start"))).over(ahead)
    free = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(next_base, F.col("end")) >= F.col("end"))
    return both.withColumn("free", free).where(~F.col("base") & (F.col("free") | F.col("seed").isNotNull())).drop("base")


def confident(found: DataFrame, how: Bootstrap) -> tuple[DataFrame, DataFrame]:
    """``pattern, kind`` of confident patterns, and ``value, kind`` of values that such patterns make believed.

    ``found`` has ``pattern, value, seed``.
    """
    edges = written(found.where("pattern IS NOT NULL").groupBy("pattern", "value").agg(F.min("seed").alias("seed")), "edges")
    seeds = edges.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    size = edges.groupBy("pattern").agg(F.count("*").alias("values"))
    belief = seeds
    for _ in range(how.rounds):
        scored = (
            edges.select("pattern", "value")
            .join(belief, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("belief").alias("believed"), F.count("*").alias("support"))
            .where(F.col("support") >= how.support)
            .join(size, "pattern")
            .select("pattern", "kind", (F.col("believed") / F.col("values")).alias("confidence"))
        )
        patterns = written(scored.where(F.col("confidence") >= how.confidence / 2), "patterns")
        doubt = F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))
        told = edges.where("seed IS NULL").join(patterns, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("belief"))
        belief = written(seeds.union(told), "beliefs")
    best = patterns.where(F.col("confidence") >= how.confidence).groupBy("pattern").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("b"))
    known = belief.where(F.col("belief") >= how.confidence).groupBy("value").agg(F.max(F.struct("belief", -F.col("kind"))).alias("b"))
    kind = (-F.col("b.col2")).alias("kind")
    return best.select("pattern", kind), known.select("value", kind)


def personal_data(docs: DataFrame, how: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, kind, start, end, base`` of every span, and a row of kind -1 for every document.

    Starts and ends are in code points, ends exclusive. Base spans of a kind don't overlap; a span of the method
    overlaps no base span of its document. Rows with the same id and text are one document; a null text is empty.
    """
    found = written(matches(docs, id_col, text_col), "matches")
    doc = ["doc_id", "text_hash"]
    base = found.where((F.col("kind") < _TOKEN_KIND) & ((F.col("kind") == _NONE) | valid(F.col("kind"), F.col("value")))).select(
        *doc, "kind", "start", "end", F.lit(True).alias("base")
    )
    candidates = written(free_tokens(base, tokens(found)), "tokens")
    seeds = found.where(F.col("kind") >= _SEED_KIND).select(_pattern(F.col("left")).alias("pattern"), "value", (F.col("kind") - _SEED_KIND).alias("seed"))
    patterns, values = confident(candidates.select("pattern", "value", "seed").union(seeds), how)
    free = candidates.where("free")
    by_pattern = free.join(patterns, "pattern").select(*doc, "kind", "start", "end")
    by_value = free.join(values, "value").select(*doc, "kind", "start", "end")
    new = by_pattern.union(by_value).groupBy(*doc, "start", "end").agg(F.min("kind").alias("kind"))
    return base.unionByName(new.withColumn("base", F.lit(False)))


def personal_data_summary(docs: DataFrame, how: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, and all spans as text."""
    spans = personal_data(docs, how, id_col, text_col)
    kind, base = F.col("kind"), F.col("base")
    name = F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)
    entry = F.struct("kind", "start", "end", F.concat_ws(":", name, "start", "end").alias("text"))

    def joined(which: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_set(F.when(which, entry))), lambda e: e["text"]), ",")

    return (
        spans.groupBy("doc_id", "text_hash")
        .agg(
            *[F.count_if(base & (kind == k)).alias(f"n_{KINDS[k]}") for k in range(len(PATTERNS))],
            F.sha2(joined(base & (kind >= 0)), 256).alias("base_sha256"),
            joined(kind >= 0).alias("spans"),
        )
        .drop("text_hash")
    )


def masked(docs: DataFrame, how: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its kind, as ``<EMAIL>``; spans that overlap are one.

    All columns stay; the text of other rows stays as it is, and so does null.
    """
    doc = ["doc_id", "text_hash"]
    spans = personal_data(docs, how, id_col, text_col).where("kind >= 0")
    before = Window.partitionBy(*doc).orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    by_place = Window.partitionBy(*doc).orderBy("start", "end", "kind")
    islands = (
        spans.withColumn("opens", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
        .withColumn("island", F.sum("opens").over(by_place))
        .groupBy(*doc, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kind").alias("kind"))
        .withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy(*doc).orderBy("start")), F.lit(0)))
        .groupBy(*doc)
        .agg(F.array_sort(F.collect_list(F.struct("start", "from", "end", "kind"))).alias("spans"))
    )
    own = free_name(docs, "pii")
    side = islands.select(F.col("doc_id").alias(f"{own}_id"), F.col("text_hash").alias(f"{own}_hash"), F.col("spans").alias(f"{own}_spans"))
    text, listed = docs[f"`{text_col}`"], side[f"{own}_spans"]
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    pieces = F.transform(listed, lambda s: F.concat(F.substring(text, s["from"] + 1, s["start"] - s["from"]), F.element_at(tags, s["kind"] + 1)))
    new = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(listed, -1)["end"] + 1, F.length(text)))
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(side[f"{own}_id"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == side[f"{own}_hash"])
    changed = F.when(listed.isNull(), text).otherwise(new)
    return docs.join(side, same, "left").select(*[changed.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns])
