"""Personal data: base patterns, and terms that give protected entities away.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_filter, may_contain, save

# The patterns of the base kinds. A match may only start where a run of its
# first class starts or where the match before it ended, and repetitions do not
# give back: the same matches, in time linear in the text.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Kind of the added spans, listed after the base kinds.
TERM = "term"
#: A word of the corpus: a whole run of letters, their marks and digits, of any length.
WORD = r"[\p{L}\p{M}\p{N}]++"
#: Stands for the characters of base spans; a noncharacter, so no text needs it.
MASK = "\U0010ffff"
#: Share of an entity's information from which a term is generalised, or removed.
GENERALISE_AT, REMOVE_AT = 0.8, 0.95
#: Distinct texts in which a term must meet an entity before it is judged.
LEAST_TEXTS = 2
#: Matches placed by one inner fold.
FOLD = 256
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def placed(text: Column, pattern: str, found: Column, kind: str) -> Column:
    """The matches with code point offsets: gaps between them come from splitting at the pattern."""
    parts = F.split(text, pattern, -1)
    none = F.array().cast(SPAN)
    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value")))

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + z["gap"]
        end = start + F.length(z["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), z["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def fold(acc: Column, block: Column) -> Column:
        inner = F.aggregate(F.slice(pairs, block * FOLD + 1, F.lit(FOLD)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / FOLD).cast("int"))
    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), fold)
    return F.when(F.size(found) > 0, F.flatten(whole["out"])).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    backwards = F.reverse(value)
    total = F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), lambda s, i: s + (lambda d: F.when(
        i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2))(F.substring(backwards, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def valid(kind: str) -> Callable[[Column], Column]:
    """Whether a match of the kind counts."""
    def card(s: Column) -> Column:
        d = digits(s["value"])
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))

    def ip(s: Column) -> Column:
        return F.forall(F.split(s["value"], r"\."), lambda p: F.when(
            F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.regexp_replace(p, "^0+(?=[0-9])", "").cast("int") <= 255).otherwise(F.lit(False)))

    return {"email": lambda s: F.lit(True), "ip": ip, "card": card, "phone": lambda s: F.length(digits(s["value"])).between(9, 15)}[kind]


def entity(span: Column) -> Column:
    """What a span protects, whatever its spelling."""
    value = F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def count_of(kind: str) -> Column:
    """How many base spans of a kind there are."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, text, spans`` with the base kinds in the order listed, each by start."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The cheap tests keep most texts away from a pattern they cannot hold.
    sign = {"email": F.contains("text", F.lit("@")), "ip": F.col("text").rlike("[0-9]\\.[0-9]"), "card": F.col("text").rlike("[0-9][\\x20-]?[0-9]"),
            "phone": F.contains("text", F.lit("+"))}
    none = F.array().cast("array<string>")
    found = texts.select("*", *[F.when(sign[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in PATTERNS.items()])
    spans = found.select("doc_id", "text", *[placed(F.col("text"), p, F.col(f"m_{k}"), k).alias(f"s_{k}") for k, p in PATTERNS.items()])
    return spans.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"), "text",
                        F.concat(*[F.filter(f"s_{k}", valid(k)) for k in KINDS]).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every character of a base span as ``MASK``; offsets stay."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    clear = F.translate(text, MASK, " ")
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        start, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        piece = F.concat(F.substring(clear, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(MASK), end - start))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    def fold(acc: Column, block: Column) -> Column:
        inner = F.aggregate(F.slice(ordered, block * FOLD + 1, F.lit(FOLD)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(inner["out"], ""))).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / FOLD).cast("int"))
    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), fold,
                        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(clear, acc["at"] + 1, F.length(clear))))
    return F.when(F.size(spans) > 0, whole).otherwise(clear)


#: A word that touches no base span, in a masked text.
_FREE = rf"(?<![\p{{L}}\p{{M}}\p{{N}}{MASK}]){WORD}(?!{MASK})"


def words_of(scanned: DataFrame) -> DataFrame:
    """``k1, k2, words`` of every row: its distinct words in lower case that touch no base span."""
    runs = F.array_distinct(F.regexp_extract_all(masked(F.col("text"), F.col("spans")), F.lit(_FREE), F.lit(0)))
    return scanned.select("k1", "k2", F.array_distinct(F.transform(runs, F.lower)).alias("words"))


def holders(found: DataFrame) -> DataFrame:
    """``entity, k1, k2``: the distinct texts that hold each entity."""
    return found.select("k1", "k2", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity")).distinct().select("entity", "k1", "k2")


def among(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``texts(k1, k2)``; the others are left where they are, by a bitmap of fixed size."""
    return may_contain(rows, key_filter(texts.select(F.col("k1").alias("k"))), "k1", "hit").filter("hit").drop("hit").join(
        texts.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), F.col("text"))})


def often_held(held: DataFrame, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """``entity, n_e``: the entities in enough distinct texts for a term to meet them often enough."""
    return held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= least_texts)


def most_texts(n: Column, n_e: Column, share: float) -> Column:
    """In how many texts a term may stand at most to give away ``share`` of an entity.

    It meets the entity in ``n_e`` texts at most, so ``log(n / n_t)`` has to reach
    ``share * log(n / n_e)``. A little more, since logarithms are rounded.
    """
    return F.exp((F.log(n) * (1 - share) + F.log(n_e) * share) * (1 + 1e-12)) + 1e-6


def contexts(docs: DataFrame, held: DataFrame, often: DataFrame, words_in: DataFrame) -> DataFrame:
    """``k1, k2, entity, n_e, term, n_t``: words of each distinct text that holds an entity, wherever they stand.

    Exact copies of a text are one: copying a document teaches nothing new
    about what a word gives away. Only entities of ``often(entity, n_e, most)`` and words
    of ``words_in(term, n_t)`` with ``n_t`` up to the entity's ``most`` are paired; no
    other pair can reach the threshold.
    """
    by_text = held.join(often, "entity").groupBy("k1", "k2").agg(
        F.max("most").alias("most"), F.collect_list(F.struct("entity", "n_e", F.col("most").alias("upto"))).alias("entities"))
    # The patterns run on the wanted texts only: a computed column would not move behind the join.
    hit = may_contain(keyed(docs), key_filter(by_text.select(F.col("k1").alias("k"))), "k1", "hit").filter("hit")
    once = words_of(base_spans(hit)).groupBy("k1", "k2").agg(F.first("words").alias("words"))
    terms = once.select("k1", "k2", F.explode("words").alias("term")).join(words_in, "term")
    met = terms.join(by_text, ["k1", "k2"]).filter(F.col("n_t") <= F.col("most"))
    each = met.select("k1", "k2", "term", "n_t", F.explode("entities").alias("e"))
    return each.filter(F.col("n_t") <= F.col("e.upto")).select("k1", "k2", "e.entity", "e.n_e", "term", "n_t")


def texts_with(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``term, n_t``: in how many distinct texts a word stands.

    Words of texts that occur once are counted where they are read, so only
    partial counts are shuffled; of repeated texts one row each is counted.
    """
    twice = key_filter(found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("k1").alias("k")))
    split = may_contain(keyed(docs), twice, "k1", "hit")  # before the patterns, so that each text meets them once
    once = words_of(base_spans(split.filter("hit"))).groupBy("k1", "k2").agg(F.first("words").alias("words"))
    every = words_of(base_spans(split.filter("not hit"))).select("words").unionByName(once.select("words"))
    # An outer explode: for an inner one the planner would work out the words a second time, to leave out texts without any.
    return every.select(F.explode_outer("words").alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosures(docs: DataFrame, generalise_at: float = GENERALISE_AT, least_texts: int = LEAST_TEXTS,
                found: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """``entity, term, share``: the part of an entity's information that a term gives away.

    With ``n`` texts, an entity in ``n_e`` of them, a term in ``n_t`` and both together
    in ``n_et``, the term reveals ``log(n * n_et / (n_e * n_t))`` of the entity's
    ``log(n / n_e)``. All counts are of distinct whole texts over the whole corpus, a
    term counting where it touches no base span; only terms that met one entity
    in ``least_texts`` of them are counted there. Words in fewer texts than that,
    or in more than any entity's bound, never meet an entity at all.
    """
    found = base_spans(docs) if found is None else found
    held = holders(found) if held is None else held
    total = found.select("k1", "k2").distinct().agg(F.count(F.lit(1)).alias("n"))
    often = often_held(held, least_texts).crossJoin(F.broadcast(total))
    often = save(often.withColumn("most", most_texts(F.col("n"), F.col("n_e"), generalise_at)), "pii-entities")
    widest = often.agg(F.max("most").alias("widest"))  # one row
    words_in = texts_with(docs, found).filter(F.col("n_t") >= least_texts)
    words_in = save(words_in.crossJoin(F.broadcast(widest)).filter(F.col("n_t") <= F.col("widest")).select("term", "n_t"), "pii-words")
    met = contexts(docs, held, often.select("entity", "n_e", "most"), words_in)
    pairs = met.groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= least_texts)
    told = pairs.crossJoin(F.broadcast(total))
    share = F.log(F.col("n") * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log(F.col("n") / F.col("n_e"))
    return told.withColumn("share", F.when(F.col("n") > F.col("n_e"), share).otherwise(F.lit(0.0))).filter(
        F.col("share") >= generalise_at).select("entity", "term", "share")


def occurrences(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``k1, k2, start, end, word, share``: everywhere that the marked terms ``k1, k2, term, share`` stand in their texts."""
    texts = base_spans(among(keyed(docs), marks).select("doc_id", "text")).dropDuplicates(["k1", "k2"])
    runs = texts.select("k1", "k2", masked(F.col("text"), F.col("spans")).alias("t"))
    each = runs.select("k1", "k2", F.explode(placed(F.col("t"), _FREE, F.regexp_extract_all("t", F.lit(_FREE), F.lit(0)), TERM)).alias("x"))
    at = each.select("k1", "k2", F.lower("x.value").alias("term"), F.col("x.value").alias("word"), "x.start", "x.end")
    return at.join(marks, ["k1", "k2", "term"]).select("k1", "k2", "start", "end", "word", "share")


def find(docs: DataFrame, generalise_at: float = GENERALISE_AT, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """``doc_id, k1, k2, spans, added``: base spans, and every occurrence of the terms that give an entity
    of the same text away.

    ``k1, k2`` are 128 bits of the text; ``rewritten`` makes the sanitised text.

    Defined results: a null text is empty; rows that repeat are treated alike;
    base spans of different kinds may overlap, added ones overlap no base span;
    an empty table gives an empty result; other columns are not looked at.
    """
    scanned = base_spans(docs)
    found = save(scanned.select("doc_id", "k1", "k2", "spans"), "pii-base")
    held = save(holders(found), "pii-holders")
    told = save(disclosures(docs, generalise_at, least_texts, found, held), "pii-told")
    marks = save(held.join(told, "entity").groupBy("k1", "k2", "term").agg(F.max("share").alias("share")), "pii-marks")
    marks = occurrences(docs, marks)
    added = save(marks.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word", "share"))).alias("added")), "pii-added")
    kind = "array<struct<start:int,end:int,word:string,share:double>>"
    joined = found.join(added, ["k1", "k2"], "left").withColumn("added", F.coalesce("added", F.array().cast(kind)))
    return joined.select("doc_id", "k1", "k2", "spans", "added")


def rewritten(docs: DataFrame, found: DataFrame, remove_at: float = REMOVE_AT) -> DataFrame:
    """``doc_id, k1, k2, sanitised``: the texts with the spans of ``find`` replaced.

    Base spans become their kind in brackets. A term that gives away ``remove_at``
    of an entity's information or more is removed; the others become ``[NAME]`` or
    ``[WORD]`` by their first letter. Of overlapping spans the first is replaced
    and the rest of the others goes with it.
    """
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    terms = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] >= remove_at, F.lit(""))
                                                    .when(F.substring(s["word"], 1, 1) != F.lower(F.substring(s["word"], 1, 1)), F.lit("[NAME]")).otherwise(F.lit("[WORD]")).alias("by")))
    by_text = found.select("k1", "k2", F.array_sort(F.concat(base, terms)).alias("cuts")).filter(F.size("cuts") > 0).dropDuplicates(["k1", "k2"])
    by_text = save(by_text, "pii-cuts")
    # Texts without a span stay where they are.
    split = may_contain(keyed(docs), key_filter(by_text.select(F.col("k1").alias("k"))), "k1", "hit")
    joined = split.filter("hit").drop("hit").join(by_text, ["k1", "k2"], "left")
    before = lambda i: F.when(i > 0, F.array_max(F.transform(F.slice("cuts", F.lit(1), i), lambda c: c["end"]))).otherwise(F.lit(0))
    piece = lambda c, i: F.when(c["start"] >= before(i), F.concat(F.substring("text", before(i) + 1, c["start"] - before(i)), c["by"])).otherwise(F.lit(""))
    rest = F.substring(F.col("text"), F.array_max(F.transform("cuts", lambda c: c["end"])) + 1, F.length("text"))
    cut = joined.select("doc_id", "k1", "k2", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(
        F.concat(F.array_join(F.transform("cuts", piece), ""), rest)).alias("sanitised"))
    return cut.unionByName(split.filter("not hit").select("doc_id", "k1", "k2", F.col("text").alias("sanitised")))
