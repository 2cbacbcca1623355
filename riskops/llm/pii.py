"""Information-theoretic sanitisation of personal data, in DataFrame functions alone.

Base spans: e-mail addresses, IP addresses, card and phone numbers by pattern and check.
Each valid value is a protected entity. Terms that stand near its mentions (``WINDOW``
characters on both sides) may disclose it even when the value itself is gone: with P(e|t) the
share of a term's contexts that lie near the entity and P(e) the share of all words that do,
their pointwise mutual information is log P(e|t)/P(e), and a term discloses the entity if
that reaches the entity's information content over alpha, that is P(e|t) >= P(e)^(1-1/alpha).
Terms beyond ``ALPHA_REMOVE`` are removed, others beyond ``ALPHA_GENERALISE`` are generalised.

A context is a term with both neighbours, and different contexts are counted, not mentions:
copies of a text, exact or nearly so, add no evidence. ``MIN_CONTEXTS`` different contexts
near the entity are asked for.

Spans are code points (start, end exclusive). A text is split at its matches, and positions
are sums over the pieces. Patterns are possessive, so long runs neither recurse nor go back;
``\\G`` or a look-behind makes a search begin where a run of its characters does.

Defined cases: null text is empty; rows with a null ``doc_id`` and repeated rows are handled
like any other, each by its own text; spans that tie in start go by kind, then end; an empty
table gives an empty result; other columns pass through ``sanitise`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone", "term")
#: Patterns (fixed values, made possessive).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
WINDOW = 120
TERM = r"\p{L}[\p{L}\p{N}'-]+"
MIN_CONTEXTS = 4
#: Terms that are looked up in the row at most.
TERMS_IN_ROW = 10_000
ALPHA_GENERALISE, ALPHA_REMOVE = 1.1, 1.02
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether up to 20 digits pass the Luhn check."""
    padded = F.lpad(digits(value), 20, "0")

    def add(total: Column, k: Column) -> Column:
        d = F.substr(padded, F.lit(21) - k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            n = F.regexp_replace(part, "^0+(?=.)", "")
            return (F.length(n) <= 3) & (F.lpad(n, 3, "0") <= "255")

        return F.forall(F.split(value, r"\."), small)
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(value)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def located(matches: Column, pieces: Column) -> Column:
    """Array of (start, end, value): the matches of a text, from them and the pieces between."""
    both = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda v, gap: F.struct(v.alias("v"), F.length(gap).alias("gap")))
    none = F.expr("struct(0 as at, cast(array() as array<struct<start:int,end:int,value:string>>) as found)")

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + x.gap
        end = start + F.length(x.v)
        return F.struct(end.alias("at"), F.concat(acc.found, F.array(F.struct(start.alias("start"), end.alias("end"), x.v.alias("value")))).alias("found"))

    return F.aggregate(both, none, step, lambda acc: acc.found)


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds ``base``: array of (start, kind number, end, value) of the valid matches, sorted."""
    t, base = F.col(text), [k for k in KINDS if k in PATTERNS]
    df = df.withColumns({f"m_{k}": F.when(t.contains(NEEDS[k]), F.regexp_extract_all(t, F.lit(PATTERNS[k]), 0)) for k in base})
    df = df.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split(t, PATTERNS[k], -1)) for k in base})
    df = df.withColumns({f"f_{k}": F.when(F.size(f"m_{k}") > 0, located(F.col(f"m_{k}"), F.col(f"p_{k}"))) for k in base})
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")

    def good(n: int, k: str) -> Column:
        found = F.filter(f"f_{k}", lambda s: valid(k, s.value))
        return F.coalesce(F.transform(found, lambda s: F.struct(s.start.alias("start"), F.lit(n).alias("kind"), s.end.alias("end"), s.value.alias("value"))), empty)

    return df.withColumn("base", F.sort_array(F.concat(*[good(n, k) for n, k in enumerate(base)]))).drop(*[f"{a}_{k}" for k in base for a in "mpf"])


def written_spans(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))))


def whole_words(window: Column, edge: str, cut: Column) -> Column:
    """A window without the word at its ``edge``, where the window cuts it: that is not a term. Where the text ends, it is whole."""
    return F.when(cut, F.regexp_replace(window, edge, " ")).otherwise(window)


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_words and base; its spans also carry the text around them."""
    t = F.col("t")
    df = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("t"))
    df = with_base_spans(df, "t")
    spaces = F.length("t") - F.length(F.translate("t", " \n\t", ""))
    around = F.transform("base", lambda s: F.struct(
        s.start, s.kind, s.end, s.value,
        whole_words(F.substr(t, F.greatest(s.start - WINDOW, F.lit(0)) + 1, F.least(s.start, F.lit(WINDOW))), r"^\S+\s", s.start > WINDOW).alias("left"),
        whole_words(F.substr(t, s.end + 1, F.lit(WINDOW)), r"\s\S+$", F.length(t) > s.end + WINDOW).alias("right"),
    ))
    return df.select("doc_id", "row_key", (spaces + 1).cast("long").alias("n_words"), around.alias("base"))


def contexts(df: DataFrame, key: str, text: str, asked: DataFrame | None = None) -> DataFrame:
    """key, term, context: each lower-case term of a text with a hash of its two neighbours; only the terms of ``asked``, if given.

    Up to TERMS_IN_ROW terms are looked up in the row, so that only texts that hold one are laid out; more are joined.
    """
    df = df.select(key, F.regexp_extract_all(F.lower(text), F.lit(TERM), 0).alias("words")).where(F.size("words") > 0)
    few = [r.term for r in asked.limit(TERMS_IN_ROW + 1).collect()] if asked is not None else None
    in_row = few is not None and len(few) <= TERMS_IN_ROW
    if in_row:
        df = df.where(F.exists("words", lambda w: w.isin(few)))
    none = F.array(F.lit(""))
    last, after = F.concat(none, F.slice("words", F.lit(1), F.size("words") - 1)), F.concat(F.slice("words", F.lit(2), F.size("words")), none)
    rows = F.arrays_zip(F.col("words").alias("term"), last.alias("last"), after.alias("after"))
    rows = df.select(key, F.inline(F.filter(rows, lambda x: x.term.isin(few)) if in_row else rows))
    if asked is not None and not in_row:
        rows = rows.join(asked, "term")
    return rows.select(key, "term", F.xxhash64("last", "after").alias("context"))


def disclosing(docs: DataFrame, base: DataFrame) -> DataFrame:
    """row_key, term, share, removed: the terms of each row that disclose a protected entity."""
    entity = F.concat_ws(":", F.col("s.kind").cast("string"), F.when(F.col("s.kind") >= 2, digits(F.col("s.value"))).otherwise(F.lower("s.value")))
    near = base.select(F.explode("base").alias("s")).select(
        F.xxhash64(entity).alias("entity"),
        F.explode(F.array("s.left", "s.right")).alias("window"),
    ).distinct()
    met = contexts(near, "entity", "window").distinct()
    met = written(met, "near_contexts")
    words = base.agg(F.sum("n_words")).first()[0] or 1  # one number
    of_entity = met.groupBy("entity").agg(F.count("*").alias("n_entity"))
    seen = met.select("term", "context").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    joint = met.groupBy("entity", "term").agg(F.count("*").alias("n_joint")).where(F.col("n_joint") >= MIN_CONTEXTS)
    least = F.pow(F.col("n_entity") / words, F.lit(1 - 1 / ALPHA_GENERALISE))
    # n_near is no more than the term's contexts in the corpus: terms that fail already here are not looked up
    asked = written(
        joint.join(of_entity, "entity").join(seen, "term")
        .where(F.col("n_joint") / F.col("n_near") >= least).select("entity", "term", "n_joint", "n_entity"), "asked_terms"
    )
    text = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("t"))
    found = written(contexts(text, "row_key", "t", asked.select("term").distinct()).distinct(), "term_contexts")
    total = found.select("term", "context").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    share = F.col("n_joint") / F.greatest("n_term", "n_joint")
    limit = F.col("n_entity") / words
    told = (
        asked.join(total, "term").withColumn("share", share).where(F.col("share") >= F.pow(limit, F.lit(1 - 1 / ALPHA_GENERALISE)))
        .groupBy("term").agg(F.max("share").alias("share"), F.max(F.col("share") >= F.pow(limit, F.lit(1 - 1 / ALPHA_REMOVE))).alias("removed"))
    )
    return written(found.select("row_key", "term").distinct().join(told, "term").select("row_key", "term", "share", "removed"), "disclosing")


def with_all_spans(df: DataFrame, text: str, told: DataFrame) -> DataFrame:
    """Adds ``spans``: ``base`` and the spans of the row's disclosing terms (value: null, or empty if removed).

    ``df`` has row_key and base; the terms of a row become one pattern, tried on its text alone.
    """
    terms = told.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("term", "removed"))).alias("told"))
    df = df.join(terms, "row_key", "left")
    # terms hold letters, digits, apostrophes and hyphens only
    any_of = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}'-])(?:"), F.concat_ws("|", F.transform("told", lambda x: x.term)), F.lit(r")(?![\p{L}\p{N}'-])"))
    df = df.withColumn("pattern", F.when(F.col("told").isNotNull(), any_of))
    df = df.withColumn("m_term", F.when(F.col("pattern").isNotNull(), F.regexp_extract_all(F.col(text), F.col("pattern"), 0)))
    df = df.withColumn("p_term", F.when(F.size("m_term") > 0, F.split(F.col(text), F.col("pattern"), -1)))
    df = df.withColumn("f_term", F.when(F.size("m_term") > 0, located(F.col("m_term"), F.col("p_term"))))
    gone = F.col("gone_terms")
    df = df.withColumn("gone_terms", F.transform(F.filter("told", lambda x: x.removed), lambda x: x.term))
    more = F.transform("f_term", lambda s: F.struct(s.start.alias("start"), F.lit(KINDS.index("term")).alias("kind"), s.end.alias("end"), F.when(F.array_contains(gone, F.lower(s.value)), F.lit("")).alias("value")))
    spans = F.when(F.col("f_term").isNotNull(), F.sort_array(F.concat("base", more))).otherwise(F.col("base"))
    return df.withColumn("spans", spans).drop("told", "pattern", "m_term", "p_term", "f_term", "gone_terms")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256 and spans of each row."""
    base = written(base_table(docs), "base_spans")
    told = disclosing(docs, base)
    plain = F.transform("base", lambda s: F.struct(s.start, s.kind, s.end, s.value))
    df = base.select("doc_id", "row_key", plain.alias("base"))
    some = told.select("row_key").distinct()
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("t"))
    texts = texts.join(some, "row_key", "left_semi").dropDuplicates(["row_key"])
    more = with_all_spans(texts.join(df.select("row_key", "base").dropDuplicates(["row_key"]), "row_key"), "t", told).select("row_key", "spans")
    df = df.join(written(more, "term_spans"), "row_key", "left").withColumn("spans", F.coalesce("spans", "base"))

    def count(n: int) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == n)).cast("long")

    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span's label in its place; of spans that overlap the first one's label."""
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS])
    none = F.expr("struct(0 as at, cast(array() as array<string>) as parts)")

    def step(acc: Column, s: Column) -> Column:
        label = F.when((s.kind == KINDS.index("term")) & (s.value == ""), F.lit("")).otherwise(F.get(labels, s.kind))
        new = F.concat(acc.parts, F.array(F.substr(text, acc.at + 1, s.start - acc.at), label))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, new).otherwise(acc.parts).alias("parts"))

    return F.aggregate(spans, none, step, lambda acc: F.concat(F.concat_ws("", acc.parts), F.substr(text, acc.at + 1, F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with spans replaced in ``text`` and, if they have it, ``n_chars`` anew; columns as they came."""
    told = disclosing(docs, written(base_table(docs), "base_spans"))
    df = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("t"))
    df = with_all_spans(with_base_spans(df, "t"), "t", told)
    df = df.withColumn("clean", F.when(F.size("spans") > 0, replaced(F.col("t"), F.col("spans"))).otherwise(F.col("row.text")))
    out = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return df.select(*[out[c].alias(c) if out.get(c) is not None else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
