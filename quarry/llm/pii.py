"""Personal data: base patterns, and terms that give protected entities away.

Base: emails, IP addresses, payment cards and telephone numbers by pattern and validity. Each value
found is a protected entity. Information-theoretic step: over all documents it is counted how often
a term occurs (outside base matches) in the documents of an entity, anywhere in them. Where the entity is taken out, such a
term may still tell it: it gives PMI(term, entity) = log2(n_te N / (n_t n_e)) of the entity's
information log2(N / n_e). Terms that give at least `disclosure` of it and do so in at least
`contexts` different neighbourhoods of words (so copies of one text are one observation) are
sanitised in the documents that hold the entity. Every entity is measured, in however few texts, and terms
are runs of letters, digits and inner hyphens of any length. Base matches and terms are generalised to their kind.

Everything is DataFrame functions on the JVM. Matches and the gaps between them (extract-all and
split by one pattern) give code point offsets. Patterns are written without repeated groups and start
only where a run starts, so time is linear in a text and the stack isn't used, however long the text.

Scale: documents are written once with their base spans, so the patterns run once. What a document loses depends on its
text alone, so results go back to documents by the hash of the text; only documents with base matches are shuffled with their text.
Entities that stand in the same texts are counted as one class, so a text with any number of entities of its own is counted once for all of
them; beyond that a text has a row for each of its classes and different words. Term counts are
pre-aggregated in tasks. Both sides of joins on hot keys are plain exchanges that AQE can split.

Defined results: null or empty text has no spans; ids may be null or repeat; an empty table gives an
empty result; input columns named like the new ones (n_email, n_ip, n_card, n_phone, spans,
clean_text) give way to them; all other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize, text_of

KINDS = ("email", "ip", "card", "phone")
NEW = (*(f"n_{k}" for k in KINDS), "spans", "clean_text")
_SPANS = "array<struct<kind:string,start:int,stop:int,value:string>>"
_LOCAL = "A-Za-z0-9._%+-"
#: What a pattern is searched in keeps all lengths: the first separator after which a match can't go on becomes "_".
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]{11,}+(?<=[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A term: letters, digits and inner hyphens, in a text where _termed has put a space for other hyphens.
_TERM = r"[\p{L}\p{N}][\p{L}\p{N}-]*+"


#: Stand around an entity where terms are counted; private code points.
_MARKS = "\ue000\ue001"


def _searched(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?![A-Za-z0-9-])", "_")
    if kind == "card":
        return F.regexp_replace(text, r"(?<=[0-9])[ -](?![0-9])", "_")
    return text


def _guard(kind: str, text: Column) -> Column:
    """False only where nothing can match; cheaper than the pattern."""
    if kind == "email":
        return text.contains("@")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    if kind == "card":
        return text.rlike("[0-9][0-9 -]{11}")
    return text.contains("+")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(backwards, i + 1, F.lit(1))) - 48
        doubled = d * (1 + i % 2)
        return (total + doubled - F.when(doubled > 9, 9).otherwise(0)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _placed(kind: str, matches: Column, gaps: Column) -> Column:
    """Valid matches with their offsets: what stands before a match are all earlier gaps and matches."""

    def step(state: Column, i: Column) -> Column:
        value = F.get(matches, i)
        start = state["at"] + F.length(F.get(gaps, i))
        stop = start + F.length(value)
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), value.alias("value")))
        return F.struct(stop.alias("at"), F.when(_valid(kind, value), F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    indexes = F.when(F.size(matches) > 0, F.sequence(F.lit(0), F.size(matches) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(indexes, zero, step, lambda s: s["out"])


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with _base: the valid spans of base kinds, by kind, then start."""
    text = text_of(text_col)
    none = F.array().cast("array<string>")
    found = {}
    for k in KINDS:
        searched, guard = _searched(k, text), _guard(k, text)
        found[f"_m_{k}"] = F.when(guard, F.regexp_extract_all(searched, F.lit(_PATTERNS[k]), F.lit(0))).otherwise(none)
        found[f"_g_{k}"] = F.when(guard, F.split(searched, _PATTERNS[k], -1)).otherwise(none)
    spans = F.concat(*(_placed(k, F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in KINDS))
    return docs.withColumns(found).withColumn("_base", spans).drop(*found)


def _value(s: Column) -> Column:
    """What a span protects, the same for different spellings."""
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"])))


def _pieces(text: Column, spans: Column, put: dict[str, str]) -> Column:
    """The text with spans (in any order, overlapping or not) replaced by what stands for their kind."""

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        stands = F.coalesce(*(F.when(s["kind"] == k, F.lit(v)) for k, v in put.items()), F.lit(""))
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(before, stands))).alias("out"),
        )

    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(order, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text) - s["at"])))


def _termed(text: Column) -> Column:
    """Terms of a lower-case text, and what stands between marks, in order."""
    return F.regexp_extract_all(F.regexp_replace(text, r"-(?![\p{L}\p{N}])", " "), F.lit(rf"{_MARKS[0]}[^{_MARKS[1]}]*+|{_TERM}"), F.lit(0))


def _observed(text: Column, base: Column) -> Column:
    """Terms of a text in order, with each base match as one word: its kind and value between marks. (Marks of the text itself are blanks.)"""
    plain = F.translate(text, _MARKS, "  ")

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        before = F.substring(plain, state["at"] + 1, s["start"] - state["at"])
        word = F.concat(F.lit(f" {_MARKS[0]}"), F.translate(_value(s), " ", ""), F.lit(f"{_MARKS[1]} "))
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(F.lower(before), word))).alias("out"),
        )

    order = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    marked = F.aggregate(order, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.lower(F.substring(plain, s["at"] + 1, F.length(plain) - s["at"]))))
    return _termed(marked)


def _telling_terms(docs: DataFrame, found: DataFrame, disclosure: float, contexts: int) -> DataFrame:
    """t1, t2, terms: texts with entities, and the terms in them that give these away."""
    texts = materialize(found.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.first("words").alias("words")), "pii-texts")
    is_entity = lambda w: w.startswith(_MARKS[0])
    # Entities that stand in the very same texts have the same counts with every term: they are one class, told by hashes of those texts.
    held = texts.select("t1", "t2", "copies", F.explode(F.array_distinct(F.filter("words", is_entity))).alias("entity"))
    often = held.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.bit_xor(F.xxhash64("t1", "t2")).alias("c1"), F.bit_xor(F.xxhash64("t2", "t1")).alias("c2"))
    often = materialize(often, "pii-often")
    classes = materialize(held.join(often, "entity").select("t1", "t2", "copies", "c1", "c2", "n_e").distinct(), "pii-classes")
    # Neighbours that differ in numbers only are one neighbourhood.
    beside = lambda i: F.regexp_replace(F.coalesce(F.get("words", i), F.lit("")), r"\p{N}", "")
    uses = F.transform("words", lambda w, i: F.struct(w.alias("term"), F.xxhash64(beside(i - 1), beside(i + 1)).alias("context")))
    uses = F.array_distinct(F.filter(uses, lambda u: ~is_entity(u["term"])))
    used = texts.select("t1", "t2", F.explode(uses).alias("u")).select("t1", "t2", "u.term", "u.context").join(classes, ["t1", "t2"])
    # One row for each class, term and neighbourhood; then one for each class and term.
    seen = used.groupBy("c1", "c2", "term", "context").agg(F.count(F.lit(1)).alias("uses")).groupBy("c1", "c2", "term").agg(F.count(F.lit(1)).alias("contexts"))
    likely = materialize(seen.where(F.col("contexts") >= contexts).select("c1", "c2", "term"), "pii-likely")
    own = F.array_distinct(F.filter("words", lambda w: ~is_entity(w)))
    together = texts.select("t1", "t2", F.explode(own).alias("term")).join(classes, ["t1", "t2"]).join(likely, ["c1", "c2", "term"])
    together = materialize(together, "pii-together")
    pairs = together.groupBy("c1", "c2", "n_e", "term").agg(F.sum("copies").alias("n_te"))
    every = F.array_distinct(_termed(F.lower(docs["text"])))
    n_t = docs.select(F.explode(every).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    # n is one row.
    scored = pairs.join(n_t, "term").join(F.broadcast(n))
    information = F.log2(F.col("n") / F.col("n_e"))
    told = F.log2(F.col("n_te") * F.col("n") / (F.greatest("n_t", "n_te") * F.col("n_e")))
    chosen = materialize(scored.where((information > 0) & (told >= disclosure * information)).select("c1", "c2", "term"), "pii-terms")
    out = materialize(together.join(chosen, ["c1", "c2", "term"]).groupBy("t1", "t2").agg(F.array_sort(F.collect_set("term")).alias("terms")), "pii-telling")
    discard(texts, often, classes, likely, together, chosen)
    return out


def _number(kind: str) -> Column:
    return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")


def _with_terms(docs: DataFrame, text: Column) -> DataFrame:
    """_spans: _base, and where the _terms stand as whole words outside base spans."""
    none = F.array().cast("array<string>")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?<![\p{L}\p{N}]-)(?:"), F.array_join("_terms", "|"), F.lit(r")(?![\p{L}\p{N}])(?!-[\p{L}\p{N}])"))
    some = F.size("_terms") > 0  # null where there are none
    found = {"_m_term": F.when(some, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none), "_g_term": F.when(some, F.split(text, pattern, -1)).otherwise(none)}
    clear = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    return docs.withColumns(found).withColumn("_spans", F.concat("_base", F.filter(_placed("term", F.col("_m_term"), F.col("_g_term")), clear)))


def sanitise(docs: DataFrame, disclosure: float = 0.9, contexts: int = 3, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, with n_email, n_ip, n_card, n_phone, spans (base ones by kind and start,
    then terms by start) and clean_text, where each span is replaced by its kind."""
    docs = docs.drop(*NEW)
    text = text_of(text_col)
    # The base patterns run once; what follows reads their spans.
    maybe = F.greatest(*(_guard(k, text) for k in KINDS))
    based = with_base(docs.where(maybe), text_col)
    plain = docs.where(~maybe).withColumn("_base", F.array().cast(_SPANS))
    based = materialize(based.unionByName(plain), "pii-base")
    some = based.where(F.size("_base") > 0)
    keys = [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]
    found = some.select(*keys, _observed(text, F.col("_base")).alias("words"))
    terms = _telling_terms(based.select(text.alias("text")), found, disclosure, contexts).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("terms").alias("_terms"))
    joined = some.withColumns({"_t1": keys[0], "_t2": keys[1]}).join(terms, ["_t1", "_t2"], "left")
    none = F.array().cast(_SPANS)
    joined = _with_terms(joined, text)
    clean = _pieces(text, F.col("_spans"), {k: f"[{k.upper()}]" for k in (*KINDS, "term")})
    counts = [_number(k).alias(f"n_{k}") for k in KINDS]
    zeros = [F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS]
    with_spans = joined.select(*docs.columns, *counts, F.col("_spans").alias("spans"), clean.alias("clean_text"))
    rest = based.where(F.size("_base") == 0).select(*docs.columns, *zeros, none.alias("spans"), text.alias("clean_text"))
    return with_spans.unionByName(rest)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
