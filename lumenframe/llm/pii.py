"""Operator 6: personal data by rules and bootstrapped contextual extraction.

DataFrame and SQL functions only.  A text is split at a kind's pattern; the
lengths of the parts and of the matches give code-point offsets.  Base spans
are the matches that pass their kind's test.

Bootstrapping works on words with a digit or ``@`` and on runs of several words
of digits and marks (candidates).  A candidate's patterns are, lower-cased, the
word before, the two words before, the word after, the words on both sides, and
the word before with the candidate's shape (runs of digits as 0, of letters as
a).  Words are looked for up to the neighbouring candidates.
Candidates that base spans cover are seeds.  Patterns and instances form a graph
on which scores pass to and fro: a pattern's confidence in a kind is the
smoothed mean score of its distinct instances, which are its seeds of any kind
and the candidates of the kind's loose form; an instance's score is the best
confidence of its patterns.  After ``rounds``, patterns with confidence
``min_confidence`` and ``min_seeds`` distinct seeds give their remaining
instances as further spans, of the surest kind; a run gives none where one of
its words does.

A null text is empty: no spans, the digest of an empty string.  Rows that
repeat get the same spans; null doc_ids are documents like others; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.storage import cut_lineage, drop

KINDS = ("email", "ip", "card", "phone")
# The base patterns, with possessive repeats and a look behind where a start inside a run could only repeat a failure.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Two words of digits and marks or more; only marks may follow the last digit or bracket of a word.
_RUN = r"(?<![^\x20\x09-\x0D])[+(]*+[0-9][0-9()./+-]*+(?:\x20[(]?[0-9][0-9()./-]*+(?=[,;:!?]*+(?:[\x20\x09-\x0D]|$)))++"
#: Least length of runs that are worth a look for a card: 14 digits.
#: Elements that are added up, or searched, one by one.
_BLOCK = 128
_LONG_RUN = r"[0-9](?:[\x20-]?[0-9]){13}"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.try_to_number(bare, F.lit("999")) <= 255)


def _luhn(found: Column) -> Column:
    digits = F.reverse(_digits(found))
    one = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: _luhn_digit(F.substring(digits, i, F.lit(1)).cast("int"), i))
    return F.length(_digits(found)).between(14, 19) & (F.aggregate(one, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _luhn_digit(d: Column, place: Column) -> Column:
    double = d * 2
    return F.when(place % 2 == 0, F.when(double > 9, double - 9).otherwise(double)).otherwise(d)


_TESTS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}
_PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
_LAST_WORD = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
_LAST_WORDS = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
_FIRST_WORD = r"^[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)"
_MAYBE = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.regexp_like(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]")),
    "card": lambda t: F.regexp_like(t, F.lit(_LONG_RUN)),
    "phone": lambda t: F.regexp_like(t, F.lit(r"\+[0-9]")),
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: inside a lambda an expression would be evaluated for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column) -> Column:
    """Slices of an array of at most _BLOCK elements, in order."""
    count = F.ceil(F.size(items) / F.lit(_BLOCK)).cast("int")
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, found, gap>>`` of a pattern's matches in code points; gap: the text since the last.

    Offsets are running sums of lengths: inside blocks, then over blocks, so
    the time grows with the matches, not with their square.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda x: x["m"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,found:string,gap:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("found"), x["g"].alias("gap"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    def placed(block: Column, first: Column) -> Column:
        return F.transform(block["out"], lambda x: F.struct((x["start"] + first).alias("start"), (x["end"] + first).alias("end"), x["found"].alias("found"), x["gap"].alias("gap")))

    def joined(inner: Column) -> Column:
        add = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        firsts = F.aggregate(inner, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])
        return F.flatten(F.zip_with(inner, firsts, placed))

    def blocks(z: Column) -> Column:
        return F.transform(_blocks(z), lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), step))

    return _let(zipped, lambda z: _let(blocks(z), joined))


def _reached(spans: Column) -> Column:
    """Blocks of spans sorted by start, each with the range it covers."""
    return F.transform(_blocks(spans), lambda s: F.struct(F.array_min(F.transform(s, lambda x: x["start"])).alias("low"), F.array_max(F.transform(s, lambda x: x["end"])).alias("high"), s.alias("spans")))


def _first_over(reached: Column, start: Column, end: Column) -> Column:
    """The first span that overlaps; null if none does."""
    near = F.filter(reached, lambda b: (b["low"] < end) & (b["high"] > start))
    return F.get(F.flatten(F.transform(near, lambda b: F.filter(b["spans"], lambda x: (x["start"] < end) & (x["end"] > start)))), F.lit(0))


def _kind_spans(text: Column, kind: str) -> Column:
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    good = F.filter(matches(text, _PATTERNS[kind]), lambda m: _TESTS[kind](m["found"]))
    spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), m["end"].alias("end")))
    return F.when(_MAYBE[kind](text), spans).otherwise(none)


def _written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _found(text: Column, pattern: str) -> Column:
    gaps = F.slice(F.split(text, pattern, -1), 2, 1 << 30)
    return F.zip_with(
        matches(text, pattern),
        gaps,
        lambda m, after: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["found"].alias("value"),
            F.lower(F.regexp_extract(m["gap"], _LAST_WORD, 1)).alias("left"),
            F.lower(F.regexp_extract(m["gap"], _LAST_WORDS, 1)).alias("lefts"),
            F.lower(F.regexp_extract(after, _FIRST_WORD, 1)).alias("right"),
            F.regexp_replace(F.regexp_replace(m["found"], "[0-9]+", "0"), r"\p{L}+", "a").alias("shape"),
        ),
    )


def _candidates(text: Column) -> Column:
    """Words, and runs of words, each with ``run``: the start of the run that holds it, or its own."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,lefts:string,right:string,shape:string>>")
    words = F.when(F.regexp_like(text, F.lit("[0-9@]")), _found(text, _CANDIDATE)).otherwise(none)
    runs = F.when(F.regexp_like(text, F.lit(r"[0-9()./-]\x20[(]?[0-9]")), _found(text, _RUN)).otherwise(none)
    # no kind has another number of digits
    runs = F.filter(runs, lambda r: F.length(_digits(r["value"])).between(10, 19))

    def both(r: Column) -> Column:
        held = _let(_reached(r), lambda b: F.transform(words, lambda w: w.withField("run", F.coalesce(_first_over(b, w["start"], w["end"])["start"], w["start"])).withField("word", F.lit(True))))
        return F.concat(held, F.transform(r, lambda x: x.withField("run", x["start"]).withField("word", F.lit(False))))

    return _let(runs, both)


_FORMS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}[^0-9]*$",
    "card": r"^(?:[^0-9]*[0-9]){14,19}[^0-9]*$",
    "phone": r"^\+?(?:[^0-9]*[0-9]){10,15}[^0-9]*$",
}


def _patterns() -> Column:
    """The patterns of a candidate: the word or two words before, the word after, both sides, the word before with the shape."""
    left, right = F.col("left") != "", F.col("right") != ""
    made = F.array(
        F.when(left, F.concat(F.lit("< "), "left")),
        F.when(F.col("lefts") != "", F.concat(F.lit("<< "), "lefts")),
        F.when(right, F.concat(F.lit("> "), "right")),
        F.when(left & right, F.concat(F.lit("<> "), "left", F.lit(" "), "right")),
        F.when(left, F.concat(F.lit("= "), "left", F.lit(" "), "shape")),
    )
    return F.filter(made, lambda x: x.isNotNull())


def _fits() -> Column:
    fits = F.lit(False)
    for i, kind in enumerate(KINDS):
        fits = fits | ((F.col("kind") == i) & F.regexp_like("value", F.lit(_FORMS[kind])))
    return fits


def _discovered(found: DataFrame, rounds: int, min_confidence: float, min_seeds: int, smooth: float) -> DataFrame:
    """Of candidates (see ``_candidates``) with ``row`` and ``k``, the base kind or null, the unseen ones of confident patterns: ``row, more``."""
    edges = found.select("value", "k", F.explode(_patterns()).alias("pattern")).groupBy("pattern", "value").agg(F.max("k").alias("k"))
    edges = cut_lineage(edges, "pii-edges")
    # a pattern without a single seed stays at 0 in all rounds
    kinds = edges.where("k is not null").groupBy("pattern", F.col("k").alias("kind")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds)
    kinds = cut_lineage(kinds, "pii-kinds")
    graph = cut_lineage(edges.join(kinds, "pattern").where(F.col("k").isNotNull() | _fits()), "pii-graph")
    best, done = None, []
    for _ in range(rounds):
        score = F.when(F.col("k") == F.col("kind"), 1.0).when(F.col("k").isNotNull(), 0.0)
        scored = graph
        if best is None:
            score = F.coalesce(score, F.lit(0.0))
        else:
            scored = graph.join(best, ["value", "kind"], "left")
            score = F.coalesce(score, F.col("best"), F.lit(0.0))
        patterns = scored.groupBy("pattern", "kind", "seeds").agg((F.sum(score) / (F.count("*") + smooth)).alias("confidence"))
        patterns = cut_lineage(patterns, "pii-patterns")
        spread = graph.where("k is null").join(patterns.drop("seeds"), ["pattern", "kind"])
        best = cut_lineage(spread.groupBy("value", "kind").agg(F.max("confidence").alias("best")), "pii-instances")
        done += [patterns, best]
    sure = patterns.where(F.col("confidence") >= min_confidence).select("pattern", "kind", "confidence")
    unseen = found.where("k is null").select("row", "run", "word", "start", "end", "value", F.explode(_patterns()).alias("pattern")).join(sure, "pattern").where(_fits())
    top = F.max(F.struct("confidence", (-F.col("kind")).alias("least")))
    spans = unseen.groupBy("row", "run", "word", "start", "end").agg((-top["least"]).alias("k"))
    # the words of one run, which are as few as it has
    spans = spans.withColumn("words", F.max("word").over(Window.partitionBy("row", "run")))
    more = spans.where(F.col("word") | ~F.col("words")).groupBy("row").agg(F.collect_list(F.struct("start", "k", "end")).alias("more"))
    more = cut_lineage(more, "pii-more")
    drop(edges, kinds, graph, *done)
    return more


def find_pii(docs: DataFrame, rounds: int = 3, min_confidence: float = 0.9, min_seeds: int = 10, smooth: float = 1.0) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans`` of each row; counts are of base spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("a"), F.crc32(text).alias("b")).alias("row"), text.alias("text"))
    # rows with nothing to find skip all patterns
    base = base.withColumns({kind: _kind_spans(F.col("text"), kind) for kind in KINDS} | {"candidates": _candidates(F.col("text"))}).drop("text")
    base = cut_lineage(base, "pii-base")
    every = F.array_sort(F.concat(*[F.col(k) for k in KINDS]))
    marked = _let(_reached(F.col("spans")), lambda b: F.transform("candidates", lambda c: c.withField("k", _first_over(b, c["start"], c["end"])["k"])))
    found = base.where("size(candidates) > 0").select("row", "candidates", every.alias("spans")).select("row", F.explode(marked).alias("c")).select("row", "c.*")
    found = cut_lineage(found, "pii-candidates")
    more = _discovered(found, rounds, min_confidence, min_seeds, smooth)
    drop(found)
    joined = base.alias("b").join(more.alias("m"), F.expr("b.row.d <=> m.row.d and b.row.a = m.row.a and b.row.b = m.row.b"), "left")
    added = F.coalesce("more", F.array().cast("array<struct<start:int,k:int,end:int>>"))
    return joined.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_written(every), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat(every, added))).alias("spans"),
        F.size(added).cast("long").alias("n_added"),
        (F.size(every) + F.size(added)).cast("long").alias("n_spans"),
    )
