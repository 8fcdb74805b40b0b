"""Personal data by pattern, and terms that disclose it by co-occurrence, with DataFrame operations alone.

Matches are found with the JVM's regular expressions; a match's place follows from the pieces that the same pattern
splits the text into. All patterns are possessive or start at one fixed sign, and arrays are swept in blocks, so that time
is linear in the text whatever the number of matches.
Terms near protected entities are then weighed over the whole corpus. An entity is a value (an address, a number) or what
many values share: a mail host, a network, an issuer, a dialling prefix. A term discloses an entity when knowing the term
makes the entity likely: most texts that hold the term hold it beside the entity, by far more than chance would have it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_ROWS, P, hot_keys, join_hot, join_keyed, materialize, release

#: The patterns of the base kinds, in their order.
_LOCAL = "A-Za-z0-9._%+-"
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
WINDOW, SUPPORT, POSTERIOR, BITS = 80, 3, 0.5, 3.0
#: Fewer contexts than SUPPORT, but two at least, do where all of them together say so many bits.
FEWEST, EVIDENCE = 2, 20.0
#: Pairs of a document and a disclosing term (at most WINDOW characters) are broadcast up to this number.
BROADCAST_PAIRS = 200_000
#: Arrays are swept in blocks of SWEEP items, texts cut in blocks of 2 ** CUT characters.
SWEEP, CUT = 512, 9
TERM = r"[\p{L}\p{N}]{4,}"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _valid_span(kind: str, span: Column) -> Column:
    return _valid(kind, span["value"])


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match of the kind passes."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.contains("+")}[kind]


_ONE = "struct<start:int,kind:int,stop:int,value:string>"
_SPAN = f"array<{_ONE}>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def swept(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step(state, item)`` gives for each item, in order; it returns the next state and the outcome, of type ``kind``.

    Appending copies an array, so outcomes gather in blocks of SWEEP first.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.array_append(acc["out"], out).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        start_ = F.struct(acc["state"].alias("state"), none.alias("out"))
        return F.aggregate(part, start_, one, lambda done: F.struct(done["state"].alias("state"), F.array_append(acc["out"], done["out"]).alias("out")))

    def whole(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / SWEEP).cast("int")), lambda b: F.slice(all_, b * SWEEP + 1, F.lit(SWEEP)))
        return F.flatten(F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), block, lambda acc: acc["out"]))

    return _let(items, lambda all_: F.when(F.size(all_) > 0, whole(all_)).otherwise(none))


def placed(text: Column, pattern: Column | str, kind: int, matches: Column) -> Column:
    """All matches of the pattern as spans: the lengths of pieces and matches before one add up to its start."""
    pairs = F.slice(
        F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("value"))), F.lit(1), F.size(matches)
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        stop = at + x["gap"] + x["size"]
        return stop, F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["value"].alias("value"))

    return F.when(F.size(matches) > 0, swept(pairs, F.lit(0), step, _ONE)).otherwise(F.array().cast(_SPAN))


def text_blocks(text: Column) -> Column:
    """The text in pieces of 2 ** CUT code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CUT}}}"), F.lit(0))


def cut(blocks: Column, a: Column, b: Column) -> Column:
    """Characters a to b (end exclusive; what is beyond the end is left out) of a text given by its blocks: time does not grow with a."""
    size = 1 << CUT
    i, j = F.shiftright(a, CUT), F.shiftright(b, CUT)
    piece = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    over = F.concat(F.substring(piece(i), a - i * size + 1, F.lit(size)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(piece(j), F.lit(1), b - j * size))
    return F.when(i == j, F.substring(piece(i), a - i * size + 1, b - a)).otherwise(over)


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Add the column spans: base matches by start and kind."""
    t = F.col(text)
    out = docs
    for kind in KINDS:
        found = F.when(_hint(kind, t), F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(f"{P}m_{kind}", found)
    parts = []
    for k, kind in enumerate(KINDS):
        spans = placed(t, PATTERNS[kind], k, F.col(f"{P}m_{kind}"))
        parts.append(F.filter(spans, partial(_valid_span, kind)))
    none = reduce(lambda a, b: a & b, [F.size(f"{P}m_{kind}") == 0 for kind in KINDS])
    return out.withColumn("spans", F.when(none, F.array().cast(_SPAN)).otherwise(F.array_sort(F.concat(*parts)))).drop(*[f"{P}m_{k}" for k in KINDS])


def _is_kind(k: int, span: Column) -> Column:
    return span["kind"] == k


def rendered(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def _text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


def _shared_part(span: Column) -> Column:
    """What an entity shares with others of its kind: mail host, network of an ip, issuer of a card, prefix of a number."""
    value = F.lower(span["value"])
    digits = _digits(value)
    parts = [F.substring_index(value, "@", -1), F.substring_index(value, ".", 2), F.substring(digits, 1, 6), F.substring(digits, 1, 6)]
    return reduce(lambda rest, k: F.when(span["kind"] == k, parts[k]).otherwise(rest), range(len(parts)), F.lit(""))


def _entities(span: Column) -> Column:
    return F.array(F.xxhash64(F.lit("value"), span["kind"], F.lower(span["value"])), F.xxhash64(F.lit("shared"), span["kind"], _shared_part(span)))


def _contexts(found: DataFrame) -> DataFrame:
    """(entities, context, text_key, term): words within WINDOW characters of a span, and the entities that it names.

    One character more is read on either side: a word that the window cuts reaches it and goes, one that the text's end or a
    sign bounds stays.
    """

    def beside(blocks: Column) -> Column:
        return F.transform(
            "spans",
            lambda s: F.struct(
                _entities(s).alias("entities"),
                cut(blocks, F.greatest(s["start"] - WINDOW - 1, F.lit(0)), s["start"]).alias("before"),
                cut(blocks, s["stop"], s["stop"] + WINDOW + 1).alias("after"),
            ),
        )

    one = found.select(_text_key(), _let(text_blocks(F.col("text")), beside).alias("near")).select("text_key", F.inline("near"))
    before = F.when(F.length("before") > WINDOW, F.regexp_replace("before", r"^[\p{L}\p{N}]++", "")).otherwise(F.col("before"))
    after = F.when(F.length("after") > WINDOW, F.regexp_replace("after", r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++\z", "")).otherwise(F.col("after"))
    near = F.lower(F.concat_ws(" ", before, after))
    return one.select("entities", "text_key", near.alias("near")).select(
        "entities", F.xxhash64("near").alias("context"), "text_key", F.explode(F.array_distinct(F.regexp_extract_all("near", F.lit(TERM), F.lit(0)))).alias("term")
    )


def _words(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, term), once for each row."""
    return docs.select("doc_id", _text_key(), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))


def _texts(words: DataFrame, key: str, name: str) -> DataFrame:
    """How many different texts hold each key."""
    return words.select(key, "text_key").distinct().groupBy(key).agg(F.count(F.lit(1)).alias(name))


def _tells(support: int, posterior: float, bits: float, evidence: float) -> Column:
    """Whether figures of a pair (n_context, n_pair, p, bits) make its term disclose its entity."""
    sure = (F.col("n_context") >= support) | (F.col("n_pair") * F.col("bits") >= evidence)
    return (F.col("p") >= posterior) & (F.col("bits") >= bits) & sure


def _with_share(pairs: DataFrame, holding: str, total: int) -> DataFrame:
    """Add p and bits, where ``holding`` texts hold the term."""
    p = F.least(F.lit(1.0), F.col("n_pair") / F.col(holding))
    return pairs.withColumn("p", p).withColumn("bits", F.log2(F.col("p") * F.lit(float(total)) / F.col("n_entity")))


def _hot(pairs: DataFrame, key: str, rows: int) -> DataFrame | None:
    return hot_keys(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "n", rows) if rows > HOT_ROWS else None


def _of_terms(words: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """Rows of ``n`` terms; a term may be in any share of the rows, so these never meet by it."""
    return words.join(F.broadcast(terms), "term") if n <= BROADCAST_ROWS else join_keyed(words, terms, "term", "inner")


def weighed(
    docs: DataFrame, found: DataFrame, posterior: float = POSTERIOR, fewest: int = FEWEST, support: int = 0, bits: float = float("-inf"), evidence: float = EVIDENCE, total: int | None = None
) -> tuple[DataFrame, DataFrame] | None:
    """Candidate pairs with their figures (entity, term, n_context, n_pair, n_term, n_entity, p, bits), and where their terms are held; None without any.

    Candidates are pairs of an entity and a term with ``fewest`` different contexts of the entity that hold the term. All shares are of different texts, so that copies of a document count once above and below: p is
    texts that hold the term beside the entity / texts that hold it, bits what p exceeds the entity's share of all texts by.
    A term is in at least as many texts as it is among those with entities. What the thresholds rule out by these alone is
    no candidate, and without candidates the other texts are not read. ``total`` is the number of different texts, if known.
    """
    near = _contexts(found).select(F.explode("entities").alias("entity"), "context", "text_key", "term")
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("context").alias("n_context"), F.count_distinct("text_key").alias("n_pair"))
    pairs = materialize(pairs.where(F.col("n_context") >= fewest))
    n_pairs = pairs.count()
    if n_pairs == 0:
        release(pairs)
        return None
    if total is None:
        total = docs.select(_text_key()).distinct().count()
    hot = _hot(pairs, "term", n_pairs)
    spans = found.select(_text_key(), F.explode("spans").alias("s")).select("text_key", F.explode(_entities(F.col("s"))).alias("entity"))
    bounded = join_hot(pairs, _texts(_words(found), "term", "n_among"), ["term"], hot)
    bounded = join_hot(bounded, _texts(spans, "entity", "n_entity"), ["entity"], _hot(pairs, "entity", n_pairs))
    hopeful = materialize(_with_share(bounded, "n_among", total).where(_tells(support, posterior, bits, evidence)).drop("n_among", "p", "bits"))
    release(pairs)
    known = hopeful.select("term").distinct()
    n_terms = known.count()
    if n_terms == 0:
        release(hopeful)
        return None
    held = materialize(_of_terms(_words(docs), known, n_terms))
    rated = materialize(_with_share(join_hot(hopeful, _texts(held, "term", "n_term"), ["term"], hot), "n_term", total))
    release(hopeful)
    return rated, held


def disclosing_terms(
    docs: DataFrame, found: DataFrame, support: int = SUPPORT, posterior: float = POSTERIOR, bits: float = BITS, evidence: float = EVIDENCE, total: int | None = None
) -> tuple[DataFrame, DataFrame] | None:
    """Terms that disclose an entity, with figures, and (doc_id, text_key, term) where each is held; None without any.

    Of the candidates (``weighed``) a term discloses the entity if p reaches ``posterior`` and bits ``bits``, and the pair has
    ``support`` different contexts, or n_pair * bits, what all its texts together say, reaches ``evidence``: 20 bits are a
    million to one against chance.
    """
    got = weighed(docs, found, posterior, min(support, FEWEST), support, bits, evidence, total)
    if got is None:
        return None
    rated, held = got
    telling = materialize(rated.where(_tells(support, posterior, bits, evidence)).groupBy("term").agg(F.max("p").alias("p"), F.max("bits").alias("bits")))
    n = telling.count()
    if n == 0:
        release(rated, held, telling)
        return None
    where = materialize(_of_terms(held, telling.select("term"), n).select("doc_id", "text_key", "term").distinct())
    release(rated, held)
    return telling, where


def _without_overlaps(spans: Column) -> Column:
    """Sorted spans without the terms that overlap a base span: one sweep from either end."""
    term = len(KINDS)

    def forward(stop: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["kind"] < term, F.greatest(stop, x["stop"])).otherwise(stop), F.struct(x.alias("span"), ((x["kind"] == term) & (x["start"] < stop)).alias("bad"))

    def backward(start: Column, x: Column) -> tuple[Column, Column]:
        s = x["span"]
        return F.when(s["kind"] < term, s["start"]).otherwise(start), F.struct(s.alias("span"), (x["bad"] | ((s["kind"] == term) & (s["stop"] > start))).alias("bad"))

    flagged = f"struct<span:{_ONE},bad:boolean>"
    once = swept(spans, F.lit(0), forward, flagged)
    return F.reverse(F.transform(F.filter(swept(F.reverse(once), F.lit(2**31 - 1), backward, flagged), lambda x: ~x["bad"]), lambda x: x["span"]))


def _spans(docs: DataFrame, id_col: str, text_col: str, **thresholds) -> DataFrame:
    """doc_id, text_key, spans (base) and span_list (with terms) for every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = materialize(base_spans(slim, "text").select("doc_id", _text_key(), "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")))
    told = disclosing_terms(slim, found.where("text is not null").select("doc_id", "spans", "text"), total=found.select("text_key").distinct().count(), **thresholds)
    plain = found.select("doc_id", "text_key", "spans", F.col("spans").alias("span_list"))
    if told is None:
        return plain
    where = told[1]
    few = where.count() <= BROADCAST_PAIRS
    terms = where.groupBy(F.col("doc_id").alias(P + "id"), F.col("text_key").alias(P + "key")).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    side = F.broadcast if few else lambda df: df
    same = F.col("doc_id").eqNullSafe(F.col(P + "id")) & (F.col("text_key") == F.col(P + "key"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    hit = base_spans(slim.withColumn("text_key", _text_key()).join(side(terms), same).drop(P + "id", P + "key").withColumn("pattern", pattern), "text")
    hit = hit.withColumn("m", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    both = _without_overlaps(F.array_sort(F.concat("spans", placed(F.col("text"), F.col("pattern"), len(KINDS), F.col("m")))))
    return plain.join(side(terms.drop("terms")), same, "left_anti").unionByName(hit.select("doc_id", "text_key", "spans", both.alias("span_list")))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, span_list.

    A span is kind:start:end in code points, end exclusive, by start and then kind (email, ip, card, phone, term), joined
    by commas; base_sha256 is over the base spans alone. Terms that overlap base spans are not repeated. Null and empty texts
    have no spans. An empty table gives an empty result. Rows that repeat an id each have the spans of their own text.
    """
    full = _spans(docs, id_col, text_col, **thresholds)
    counts = [F.size(F.filter("span_list", partial(_is_kind, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate([*KINDS, "term"])]
    return full.select("doc_id", *counts, F.sha2(rendered(F.col("spans")).cast("binary"), 256).alias("base_sha256"), rendered(F.col("span_list")).alias("spans"), "span_list")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """doc_id and the text with every base span generalised to its kind, as [EMAIL], and every disclosing term removed.

    One row per input row. Of overlapping spans all characters go, replaced once, by the kind of the first. Null texts become empty.
    """
    known = _spans(docs, id_col, text_col, **thresholds).where(F.size("span_list") > 0)
    known = known.select(F.col("doc_id").alias(P + "id"), F.col("text_key").alias(P + "key"), "span_list").dropDuplicates([P + "id", P + "key"])
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", _text_key())
    slim = slim.join(known, F.col("doc_id").eqNullSafe(F.col(P + "id")) & (F.col("text_key") == F.col(P + "key")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        first = x["start"] >= at
        return F.greatest(at, x["stop"]), F.struct(F.when(first, at).alias("a"), x["start"].alias("b"), F.get(names, x["kind"]).alias("name"))

    pieces = F.filter(swept(F.col("span_list"), F.lit(0), step, "struct<a:int,b:int,name:string>"), lambda x: x["a"].isNotNull())
    end = F.array_max(F.transform("span_list", lambda x: x["stop"]))
    clean = _let(text_blocks(F.col("text")), lambda blocks: F.concat(F.array_join(F.transform(pieces, lambda x: F.concat(cut(blocks, x["a"], x["b"]), x["name"])), ""), cut(blocks, end, F.lit(2**31 - 2))))
    return slim.select("doc_id", F.when(F.col("span_list").isNull(), F.col("text")).otherwise(clean).alias("text"))
