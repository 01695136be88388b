"""Assessment of drafts, quotes and findings, for all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize

# -- reports ----------------------------------------------------------------

#: One stored result inside a report.
RESULT_SCHEMA = (
    "array<struct<criterion_id:int, compliance_state:string, raw_confidence:double, needs_review:boolean, "
    "ended_by:string, cost_usd:double, relevant_quotes:array<struct<text:string, verified:boolean>>>>"
)


def pack_reports(results: DataFrame) -> DataFrame:
    """One JSON report per run from its per-criterion rows.

    A run has one row per criterion of the dimension, so the list is short.
    """
    quotes = F.transform(
        F.sequence(F.lit(1), F.col("claimed")),
        lambda i: F.struct(F.concat(F.lit("quote "), i.cast("string")).alias("text"),
                           (i <= F.col("verified")).alias("verified")))
    row = F.struct(
        "criterion_id", F.col("state").alias("compliance_state"), "raw_confidence",
        (F.col("needs_review") == 1).alias("needs_review"), "ended_by", "cost_usd",
        F.when(F.col("claimed") > 0, quotes).otherwise(F.array().cast(
            "array<struct<text:string, verified:boolean>>")).alias("relevant_quotes"))
    return (
        results.groupBy("run_id").agg(F.array_sort(F.collect_list(row)).alias("results"))
        .select("run_id", F.to_json(F.struct("run_id", "results")).alias("report_json"))
    )


def parse_reports(reports: DataFrame) -> DataFrame:
    """The stored text back as a typed list; unreadable text is an empty list."""
    parsed = F.from_json("report_json", f"struct<run_id:bigint, results:{RESULT_SCHEMA}>")
    return reports.withColumn(
        "results", F.coalesce(parsed["results"], F.array().cast(RESULT_SCHEMA)))


def unpack_reports(reports: DataFrame) -> DataFrame:
    """One row per criterion of every stored report."""
    return parse_reports(reports).select("run_id", F.explode("results").alias("r")).select(
        "run_id", "r.*").withColumnRenamed("compliance_state", "state")


def record_criteria(results: DataFrame) -> DataFrame:
    """The per-criterion history row: quote counts instead of quotes."""
    return results.where(F.col("criterion_id").isNotNull()).select(
        "run_id", "criterion_id", "state", "raw_confidence",
        F.col("needs_review").cast("int").alias("needs_review"), "ended_by", "cost_usd",
        F.size("relevant_quotes").alias("quotes_total"),
        F.size(F.filter("relevant_quotes", lambda q: q["verified"])).alias("quotes_verified"))


def backfill(present: DataFrame, mined: DataFrame) -> DataFrame:
    """Rows mined from reports are added where the key is absent; present rows stay."""
    new = mined.join(present.select("run_id", "criterion_id"), ["run_id", "criterion_id"], "left_anti")
    return present.unionByName(new)


def trim_verdicts(reports: DataFrame, detail: str) -> DataFrame:
    """State counts per report, and verdicts whose quotes show only at full detail."""
    parsed = parse_reports(reports)
    empty = F.array().cast("array<struct<text:string, verified:boolean>>")
    verdicts = F.transform("results", lambda r: F.struct(
        r["criterion_id"].alias("criterion_id"), r["compliance_state"].alias("state"),
        (r["relevant_quotes"] if detail == "full" else empty).alias("quotes")))
    names = F.array_distinct(F.filter(
        F.transform("results", lambda r: r["compliance_state"]), lambda s: s.isNotNull()))
    states = F.map_from_entries(F.transform(names, lambda s: F.struct(
        s, F.size(F.filter("results", lambda r: r["compliance_state"] == s)))))
    return parsed.withColumns({"states": states, "verdicts": verdicts})


# -- quotes -----------------------------------------------------------------

# Length cap of a quote, confidence bounds, review cap, disagreement.
MAX_QUOTE = 300
FLOOR, CEILING, REVIEW_CAP, DISAGREEMENT = 0.05, 0.95, 0.5, 0.6
MAX_ROUNDS = 1
# States from best to worst, and the tool arguments that say what was searched.
STATES = ("Fully Compliant", "Partially Compliant", "Non-Compliant")
QUERY_ARGS = ("query", "section", "label", "prefix")
GRAM = 3
DRAFT = ["run_id", "criterion_id"]
DEALT = 256


def quote_in(quote: Column, *passages: Column) -> Column:
    """Whether the normal form of a quote lies in that of a passage; empty never."""
    forms = F.struct(
        tx.normal_quote(quote).alias("needle"), F.array(*[tx.normal_quote(p) for p in passages]).alias("hay"))
    return tx.bind(forms, lambda f: (f["needle"] != "") & F.exists(
        f["hay"], lambda h: F.coalesce(F.contains(h, f["needle"]), F.lit(False))))


def verify_quotes(quotes: DataFrame, evidence: DataFrame, *, normal: str | None = None) -> DataFrame:
    """Quotes joined to the passage they cite: ``known`` and ``verified``, and in a column ``normal`` the quote's normal form."""
    have = evidence.select("run_id", "evidence_id", F.col("text").alias("_passage"))
    cited = quotes.join(have, ["run_id", "evidence_id"], "left").withColumn("known", F.col("_passage").isNotNull())
    if normal is None:
        return cited.withColumn("verified", F.coalesce(quote_in(F.col("text"), F.col("_passage")), F.lit(False))).drop("_passage")
    forms = F.struct(tx.normal_quote(F.col("text")).alias("needle"), tx.normal_quote(F.col("_passage")).alias("hay"))
    both = tx.bind(forms, lambda f: F.struct(f["needle"].alias("needle"), ((f["needle"] != "") & F.contains(f["hay"], f["needle"])).alias("inside")))
    return cited.withColumn("_both", both).withColumns({
        "verified": F.coalesce(F.col("_both.inside"), F.lit(False)), normal: F.col("_both.needle")}).drop("_passage", "_both")


def find_quotes(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """(quote_id, passage_id) for quotes found anywhere in a table of passages.

    Passages and quotes are looked at once per distinct text. White space parts
    both into words, so a quote of one word lies inside a word of the passage; of
    a longer one, the first word ends a word of the passage, the last one begins
    one, and those between stand whole. What may match is therefore decided over
    the distinct words: a one-word quote's hits are exact; a quote of two to four
    words is looked up by its rarest word, one of five or more by its rarest run
    of three inner words, and only those candidates are compared in full. Nothing
    is paired without an equal key.
    """
    q = quotes.select("quote_id", tx.normal_quote(F.col("quote")).alias("needle")).where("needle != ''")
    normal = passages.select("passage_id", tx.normal_quote(F.col("passage")).alias("hay")).where("hay IS NOT NULL")
    # The normal form is costly: worked out once, and each distinct text written once for the steps below.
    keyed = materialize(normal.select("passage_id", F.sha2("hay", 256).alias("text_id"), "hay"), "normal-passages")
    members = keyed.select("passage_id", "text_id")
    first = members.groupBy("text_id").agg(F.min("passage_id").alias("passage_id"))
    p = materialize(keyed.join(first, ["passage_id", "text_id"], "left_semi").select("text_id", "hay"), "passages")
    asked = q.select("needle").distinct().withColumn("words", F.split("needle", " "))
    n = F.size("words")

    tokens = p.select("text_id", F.explode(F.array_distinct(F.split("hay", " "))).alias("token"))
    vocabulary = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("texts")), "words-of-passages")
    inside = _words_inside(asked.where(n == 1).select("needle", F.col("words")[0].alias("w")), vocabulary)
    exact = inside.join(tokens, "token").select("needle", "text_id").distinct()

    rarest = _rarest_word(asked.where((n > 1) & (n < GRAM + 2)), vocabulary)
    maybe = rarest.join(tokens, "token").select("needle", "text_id").distinct()
    maybe = maybe.unionByName(_rarest_run(asked.where(n >= GRAM + 2), p))
    sure = maybe.join(p, "text_id").where(F.contains("hay", "needle")).select("needle", "text_id").distinct()
    return exact.unionByName(sure).join(q, "needle").join(members, "text_id").select("quote_id", "passage_id")


def _edges(word: Column, side: str) -> Column:
    """The first or last one to ``GRAM`` letters of a word: keys that a shorter word at that end has among them."""
    cut = (lambda k: F.left(word, F.lit(k))) if side == "first" else (lambda k: F.right(word, F.lit(k)))
    return F.array_distinct(F.array(*[cut(k) for k in range(1, GRAM + 1)]))


def _words_inside(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(needle, token) for the distinct words that hold ``w``, met by letter runs of up to ``GRAM``."""
    runs = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length("token"), F.lit(1))),
        lambda i: F.array(*[F.substr("token", i, F.lit(k)) for k in range(1, GRAM + 1)]))))
    letters = vocabulary.select("token", F.explode(runs).alias("g"))
    return asked.withColumn("g", F.left("w", F.lit(GRAM))).join(letters, "g").where(F.contains("token", "w")).select("needle", "token").distinct()


def _rarest_word(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(needle, token) for the word of each quote that the fewest texts hold; none where a word is in no text."""
    pieces = asked.select("needle", F.size("words").alias("m"), F.posexplode("words").alias("at", "w"))
    last = F.col("at") == F.col("m") - 1
    ends = vocabulary.select("token", "texts", F.explode(_edges(F.col("token"), "last")).alias("g"))
    begins = vocabulary.select("token", "texts", F.explode(_edges(F.col("token"), "first")).alias("g"))
    whole = pieces.where((F.col("at") > 0) & ~last).join(vocabulary.withColumnRenamed("token", "w"), "w").withColumn("token", F.col("w"))
    head = pieces.where("at = 0").withColumn("g", F.right("w", F.lit(GRAM))).join(ends, "g").where(F.endswith("token", "w"))
    tail = pieces.where(last).withColumn("g", F.left("w", F.lit(GRAM))).join(begins, "g").where(F.startswith("token", "w"))
    columns = ["needle", "m", "at", "token", "texts"]
    found = head.select(*columns).unionByName(whole.select(*columns)).unionByName(tail.select(*columns))
    spread = found.groupBy("needle", "m", "at").agg(F.sum("texts").alias("texts"))
    best = spread.groupBy("needle", "m").agg(F.min_by("at", F.struct("texts", "at")).alias("at"), F.count(F.lit(1)).alias("pieces"))
    return found.join(best.where("pieces = m").select("needle", "at"), ["needle", "at"]).select("needle", "token")


def _rarest_run(asked: DataFrame, p: DataFrame) -> DataFrame:
    """(needle, text_id) for the texts that hold the quote's rarest run of three inner words."""

    def grams(text: str, first: int, last_off: int) -> Column:
        def hashes(words: Column) -> Column:
            n = F.size(words)
            at = F.when(n >= first + GRAM - 1 + last_off, F.sequence(F.lit(first), n - (GRAM - 1) - last_off))
            return F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.xxhash64(
                *[F.element_at(words, i + k) for k in range(GRAM)]))

        return F.array_distinct(tx.bind(F.split(F.col(text), " "), hashes))

    wanted = asked.select("needle", F.explode(grams("needle", 2, 1)).alias("gram"))
    held = p.select("text_id", F.explode(grams("hay", 1, 0)).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    spread = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(spread, "gram", "left").groupBy("needle").agg(
        F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r"))
    return rarest.where(F.col("r.n").isNotNull()).select("needle", F.col("r.gram").alias("gram")).join(held, "gram").select("needle", "text_id")


def derived_state(met: Column, settled: Column, total: Column) -> Column:
    """State implied by counts of met, of met or partial, and of all statuses."""
    return (
        F.when((total > 0) & (met == total), STATES[0]).when(settled > 0, STATES[1]).otherwise(STATES[2])
    )


def derived_states(subs: DataFrame) -> DataFrame:
    met = F.count(F.when(F.col("status") == "met", 1))
    settled = F.count(F.when(F.col("status").isin("met", "partial"), 1))
    return subs.groupBy(*DRAFT).agg(derived_state(met, settled, F.count(F.lit(1))).alias("implied"))


# -- structural checks ------------------------------------------------------


def _violations(rows: DataFrame, keys: list[str], rules: list[tuple[Column, ...]]) -> DataFrame:
    """One row (path, code and, where the rules have one, message) per rule that holds on a row."""
    names = ("path", "code", "message")
    found = F.filter(
        F.array(*[F.when(bad, F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, said)])) for bad, *said in rules]),
        lambda v: v.isNotNull())
    return rows.select(*keys, F.inline(found))


def _at(name: str, index: Column, field: str = "") -> Column:
    return F.concat(F.lit(f"{name}["), index.cast("string"), F.lit(f"]{field}"))


def with_criteria(drafts: DataFrame, criteria: DataFrame) -> DataFrame:
    """Drafts with the columns of their criterion.

    There are few criteria and each has drafts of every run, so a criterion's
    drafts are dealt by run to ``DEALT`` parts, and its row goes to all of them.
    """
    parts = criteria.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    dealt = drafts.withColumn("_part", F.pmod(F.xxhash64("run_id"), F.lit(DEALT)).cast("int"))
    return dealt.join(parts, ["criterion_id", "_part"]).drop("_part")


def validate_structure(
    drafts: DataFrame, quotes: DataFrame, subs: DataFrame, evidence: DataFrame, criteria: DataFrame
) -> DataFrame:
    """Every structural violation of every draft as (run_id, criterion_id, path, code, message).

    Quotes hold (idx, text, evidence_id), sub-requirements (pos, sub_id, status,
    quote_indexes) and criteria (criterion_id, question, sub_ids). A message
    names the offending id, length, indexes or status and what would be right.
    """
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    # What a run has retrieved: capped by its ledger, in the order of its numbers.
    held = evidence.groupBy("run_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.char_length("evidence_id").alias("n"), "evidence_id"))), lambda e: e["evidence_id"]), ", ").alias("_held"))
    # What the rules ask of a quote's text is worked out before its rows go to their run, which then carry the normal form alone.
    judged = verify_quotes(quotes, evidence, normal="_norm").select(
        *DRAFT, "idx", "evidence_id", "known", "verified", "_norm", F.char_length("text").alias("_length"), (tx.strip(F.col("text")) == "").alias("_blank"))
    checked = judged.join(held, "run_id", "left")
    # The quotes of one draft are a model's single answer, so this window is small.
    rows = checked.withColumn("_first", F.min("idx").over(Window.partitionBy(*DRAFT, "_norm", "evidence_id")))
    i, name = F.col("idx"), "relevant_quotes"
    cited_id, length = F.coalesce("evidence_id", F.lit("None")), F.col("_length")
    # The wording of every violation.
    # Written by themselves, so that the texts shuffled for them are off the disk before the other checks.
    quote_errors = materialize(_violations(rows, DRAFT, [
        (~F.col("known"), _at(name, i, ".evidence_id"), "unknown_evidence",
         said("'", cited_id, "' is not a retrieved passage; use one of ", F.coalesce("_held", F.lit("(none retrieved)")))),
        (F.col("known") & ~F.col("verified"), _at(name, i, ".text"), "not_verbatim", said("not verbatim in ", cited_id, " -- copy the exact text")),
        (length > MAX_QUOTE, _at(name, i, ".text"), "too_long", said(length, f" characters; at most {MAX_QUOTE}")),
        (F.col("_blank"), _at(name, i, ".text"), "empty", "empty quote"),
        (i > F.col("_first"), _at(name, i), "duplicate", "duplicates an earlier quote")]), "quote-errors")

    counts = quotes.groupBy(*DRAFT).agg(F.count(F.lit(1)).alias("_n"))
    cited = subs.join(counts, DRAFT, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    pos, used, status = F.col("pos"), F.size("quote_indexes") > 0, F.col("status")
    path = _at("sub_requirements", pos, ".quote_indexes")
    outside = F.filter("quote_indexes", lambda q: (q < 0) | (q >= F.col("_n")))
    sub_errors = _violations(cited, DRAFT, [
        (F.size(outside) > 0, path, "out_of_range",
         said("[", F.array_join(outside.cast("array<string>"), ", "), "] are not indexes into relevant_quotes (0..", F.col("_n") - 1, ")")),
        (status.isin("met", "partial") & ~used, path, "needs_quote", said("status '", status, "' needs at least one supporting quote index")),
        (status.isin("missing", "not_determined") & used, path, "unexpected_quote", said("status '", status, "' must have no quote indexes"))])

    got = subs.groupBy(*DRAFT).agg(
        F.array_sort(F.collect_list("sub_id")).alias("got"), F.count(F.when(status == "met", 1)).alias("_met"),
        F.count(F.when(status.isin("met", "partial"), 1)).alias("_set"), F.count(F.lit(1)).alias("_all"))
    dims = criteria.select("criterion_id", F.col("question").alias("_question"), F.array_join("sub_ids", ", ").alias("_ids"), F.array_sort("sub_ids").alias("_want"))
    whole = with_criteria(drafts.join(got, DRAFT, "left"), dims).withColumn(
        "_same", F.coalesce(F.col("got") == F.col("_want"), F.lit(False)))
    implied = derived_state(F.col("_met"), F.col("_set"), F.col("_all"))
    draft_errors = _violations(whole, DRAFT, [
        (F.col("question") != F.col("_question"), "compliance_question", "not_verbatim",
         "must equal the question exactly as given -- copy it, do not paraphrase"),
        (~F.col("_same"), "sub_requirements", "ids", said("must contain exactly these ids, once each: ", F.col("_ids"))),
        (F.col("_same") & (F.col("state") != implied), "compliance_state", "inconsistent",
         "does not follow from the sub-requirement statuses (all met = Fully; none met or partial = Non-Compliant; otherwise Partially)"),
        (tx.strip(F.col("rationale")) == "", "rationale", "empty", "must not be empty"),
        (~F.col("raw_confidence").between(0, 1), "raw_confidence", "range", "must be between 0 and 1")])
    return quote_errors.unionByName(sub_errors).unionByName(draft_errors)


def keep_quotes(quotes: DataFrame, errors: DataFrame, evidence: DataFrame) -> DataFrame:
    """Quotes without a violation, renumbered from 0 in their draft.

    The failed ones are written first: what the checks shuffled is off the disk
    when the quotes are looked up once more.
    """
    failed = materialize(errors.where(F.col("path").startswith("relevant_quotes[")).select(
        *DRAFT, F.regexp_extract("path", r"\[(\d+)\]", 1).cast("int").alias("idx")).distinct(), "failed-quotes")
    kept = verify_quotes(quotes, evidence).join(failed, [*DRAFT, "idx"], "left_anti")
    return kept.withColumn("new_idx", F.row_number().over(Window.partitionBy(*DRAFT).orderBy("idx")) - 1)


def remap_indexes(subs: DataFrame, kept: DataFrame) -> DataFrame:
    """Sub-requirements pointing at the renumbered quotes; dropped ones vanish."""
    cites = subs.select(*DRAFT, "pos", F.posexplode("quote_indexes").alias("slot", "idx"))
    moved = cites.join(kept.select(*DRAFT, "idx", "new_idx"), [*DRAFT, "idx"]).groupBy(*DRAFT, "pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "new_idx"))), lambda x: x["new_idx"]).alias("quote_indexes"))
    return subs.drop("quote_indexes").join(moved, [*DRAFT, "pos"], "left").withColumn(
        "quote_indexes", F.coalesce("quote_indexes", F.array().cast("array<int>")))


def undetermined(drafts: DataFrame, subs: DataFrame, expected: DataFrame) -> DataFrame:
    """Statuses ``not_determined`` plus expected sub-requirements a draft left out."""
    own = subs.groupBy(*DRAFT).agg(F.count(F.when(F.col("status") == "not_determined", 1)).alias("open"), F.collect_set("sub_id").alias("_own"))
    criteria = expected.groupBy("criterion_id").agg(F.count(F.lit(1)).alias("total"), F.collect_set("sub_id").alias("_want"))
    out = with_criteria(drafts.select(*DRAFT).join(own, DRAFT, "left"), criteria)
    present = F.coalesce(F.size(F.array_intersect("_own", "_want")), F.lit(0))
    return out.select(*DRAFT, "total", (F.coalesce("open", F.lit(0)) + F.col("total") - present).alias("not_determined"))


# -- confidence -------------------------------------------------------------


def confidence(
    raw: Column, *, verified: Column, claimed: Column, not_determined: Column, total: Column, needs_review: Column,
    ended_by: Column, critic: Column, support: Column, agreed: Column,
) -> dict[str, Column]:
    """The composed score and its parts; ``critic`` and ``support`` may be NULL."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    own = unit(raw)
    quote_term = F.coalesce(support, F.when(claimed > 0, verified / claimed).otherwise(1.0))
    coverage = F.when(total > 0, 1 - not_determined / total).otherwise(1.0)
    estimate = F.when(critic.isNull(), own).otherwise(F.least(own, unit(critic)))
    agreement = F.when(agreed, 1.0).otherwise(DISAGREEMENT)
    value = estimate * quote_term * coverage * agreement
    capped = needs_review | (ended_by == "cap")
    held = F.when(capped, F.least(value, F.lit(REVIEW_CAP))).otherwise(value)
    parts = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("raw", "quote_term", "coverage", "cap")]),
        F.array(own, F.round(quote_term, 3), F.round(coverage, 3), F.when(capped, REVIEW_CAP).otherwise(1.0)))
    judged = F.map_from_arrays(F.array(F.lit("critic"), F.lit("agreement")), F.array(F.round(unit(critic), 3), agreement))
    return {
        "confidence": F.round(F.least(F.lit(CEILING), F.greatest(F.lit(FLOOR), held)), 3),
        "components": F.when(critic.isNull(), parts).otherwise(F.map_concat(parts, judged)),
    }


def bucket(value: Column) -> Column:
    return F.when(value >= 0.75, "High").when(value >= 0.5, "Medium").otherwise("Low")


# -- terms ------------------------------------------------------------------


def distinctive_terms(subs: DataFrame) -> DataFrame:
    """Terms of each sub-requirement that neither siblings nor the criterion share.

    ``subs`` hold (criterion_id, sub_id, requirement, criterion_requirement).
    Sharing is a count per (criterion, term); a criterion with very many
    sub-requirements is spread over its terms. Falls back to all terms.
    """
    each = subs.select("criterion_id", "sub_id", tx.content_terms(F.col("requirement")).alias("terms"), "criterion_requirement")
    asked = tx.bind(tx.content_terms(F.col("criterion_requirement")), lambda c: F.transform(
        "terms", lambda t: F.struct(t.alias("term"), (~F.coalesce(F.array_contains(c, t), F.lit(False))).alias("free"))))
    # An outer explode: for an inner one the planner works the terms out twice.
    rows = each.select("criterion_id", "sub_id", F.explode_outer(asked).alias("t")).select("criterion_id", "sub_id", "t.*")
    once = rows.where("term IS NOT NULL AND criterion_id IS NOT NULL").groupBy("criterion_id", "term").agg(
        F.count(F.lit(1)).alias("n"), F.first("sub_id").alias("sub_id"), F.bool_and("free").alias("free")).where("n = 1 AND free")
    parts = each.select("criterion_id", "sub_id", "terms", F.lit(None).cast("string").alias("own")).unionByName(
        once.select("criterion_id", "sub_id", F.col("term").alias("own")), allowMissingColumns=True)
    return parts.groupBy("criterion_id", "sub_id").agg(
        F.array_sort(F.collect_set("own")).alias("own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("every"),
    ).select("criterion_id", "sub_id", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("every")).alias("terms"))


def unsearched(missing: DataFrame, terms: DataFrame, queries: DataFrame) -> DataFrame:
    """Missing sub-requirements (run, criterion, sub) no query of the run looked for."""
    gaps = missing.join(terms, ["criterion_id", "sub_id"]).where(F.size("terms") > 0)
    asked = queries.select("run_id", F.explode(tx.content_terms(F.col("query"))).alias("term")).distinct()
    covered = gaps.select(*DRAFT, "sub_id", F.explode("terms").alias("term")).join(asked, ["run_id", "term"], "left_semi")
    return gaps.join(covered.select(*DRAFT, "sub_id").distinct(), [*DRAFT, "sub_id"], "left_anti").select(*DRAFT, "sub_id")


def precheck(quotes: DataFrame, subs: DataFrame) -> DataFrame:
    """Hedge terms of the quotes cited under a met or partial status; others none."""
    cited = subs.where(F.col("status").isin("met", "partial")).select(*DRAFT, F.explode("quote_indexes").alias("idx")).distinct()
    rows = quotes.join(cited.withColumn("_cited", F.lit(True)), [*DRAFT, "idx"], "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("hedge_terms", F.when(F.col("_cited"), tx.hedge_terms(tx.normal_quote(F.col("text")))).otherwise(none)).drop("_cited")


def search_queries(calls: DataFrame) -> DataFrame:
    """Text arguments of tool calls (run_id, seq, args map) that say what was searched."""
    names = F.array(*[F.lit(n) for n in QUERY_ARGS])
    picked = calls.select("run_id", "seq", F.explode("args").alias("name", "query"))
    return picked.where(F.array_contains(names, F.col("name")) & (tx.strip(F.coalesce("query", F.lit(""))) != ""))


def cited_passages(quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per draft only the passages its quotes cite."""
    cites = quotes.select(*DRAFT, "evidence_id").distinct()
    return cites.join(evidence, ["run_id", "evidence_id"])


# -- findings and decisions -------------------------------------------------

KEY = ["run_id", "criterion_id", "round"]


def support_ratio(support: DataFrame, statuses: DataFrame) -> DataFrame:
    """Share of judged claims that carried: partial counts whole when partial was claimed.

    Statuses grow with the runs and are sorted, never broadcast: Spark takes a
    compressed file's size for the table's and does not count exploded rows.
    """
    claimed = statuses.select(*DRAFT, "sub_id", F.col("status").alias("_claimed")).hint("merge")
    score = (
        F.when(F.col("support") == "supports", 1.0)
        .when((F.col("support") == "partial") & (F.coalesce("_claimed", F.lit("")) == "partial"), 1.0)
        .when(F.col("support") == "partial", 0.5).otherwise(0.0))
    return support.join(claimed, [*DRAFT, "sub_id"], "left").groupBy(*KEY).agg(F.avg(score).alias("support_ratio"))


def validate_findings(findings: DataFrame, support: DataFrame, agreements: DataFrame, missing: DataFrame,
                      quote_counts: DataFrame, known_subs: DataFrame) -> DataFrame:
    """Findings that refer to nothing: (run, criterion, round, path, code).

    What they are looked up in grows with the runs and is sorted, never broadcast.
    """
    known = known_subs.select(*DRAFT, "sub_id", F.lit(True).alias("_known")).distinct().hint("merge")
    judged = support.join(quote_counts.hint("merge"), DRAFT, "left").join(known, [*DRAFT, "sub_id"], "left")
    n, i, name = F.coalesce("n_quotes", F.lit(0)), F.col("pos"), "quote_support"
    out_of_range = (F.col("quote_index") < 0) | (F.col("quote_index") >= n)
    a = _violations(judged, KEY, [
        (out_of_range, _at(name, i, ".quote_index"), "out_of_range"),
        (F.col("_known").isNull(), _at(name, i, ".sub_requirement_id"), "unknown_sub_requirement")])
    first = agreements.groupBy(*KEY, "sub_id").agg(F.min("pos").alias("_first"))
    rated = agreements.join(first.hint("merge"), [*KEY, "sub_id"]).join(known, [*DRAFT, "sub_id"], "left")
    b = _violations(rated, KEY, [
        (F.col("_known").isNull(), _at("status_agreement", i, ".sub_requirement_id"), "unknown_sub_requirement"),
        (F.col("_known").isNotNull() & (i > F.col("_first")), _at("status_agreement", i), "duplicate")])
    lost = missing.join(known, [*DRAFT, "sub_id"], "left_anti").select(*KEY).distinct()
    c = lost.select(*KEY, F.lit("missing_searches").alias("path"), F.lit("unknown_sub_requirement").alias("code"))
    d = findings.where(~F.col("critic_confidence").between(0, 1)).select(
        *KEY, F.lit("critic_confidence").alias("path"), F.lit("range").alias("code"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def merge_gaps(critic: Column, prechecked: Column) -> Column:
    """Gaps of the critic and of the pre-check, sorted; none is ever removed."""
    return F.array_sort(F.array_union(critic, prechecked))


def disputed(support: DataFrame, agreements: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (support.where(F.col("support").isin("irrelevant", "contradicts")),
            agreements.where(F.col("agreement") != "agree"))


def decide(findings: DataFrame, support: DataFrame, agreements: DataFrame, missing: DataFrame,
           max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """accept, revise (research before redraft) or fallback, with ordered reason codes."""
    quotes, statuses = disputed(support, agreements)
    reasons = (
        quotes.select(*KEY, F.lit(1).alias("o"), "pos", F.concat(F.lit("quote_"), "support").alias("reason"))
        .unionByName(statuses.select(*KEY, F.lit(2).alias("o"), "pos", F.concat(F.lit("status_"), "agreement").alias("reason")))
        .unionByName(findings.where("state_agreement = 'disagree'").select(*KEY, F.lit(3).alias("o"), F.lit(0).alias("pos"), F.lit("state_disagreement").alias("reason")))
        .unionByName(missing.select(*KEY, F.lit(4).alias("o"), "pos", F.lit("unsearched_requirement").alias("reason"))))
    listed = reasons.groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "pos", "reason"))), lambda r: r["reason"]).alias("reasons"))
    out = findings.join(listed, KEY, "left")
    none = F.col("reasons").isNull()
    verdict = F.when(none, "accept").when(F.col("round") >= max_rounds, "fallback").otherwise("revise")
    research = F.array_contains(F.coalesce("reasons", F.array().cast("array<string>")), "unsearched_requirement")
    return out.withColumns({
        "verdict": verdict, "reasons": F.coalesce("reasons", F.array().cast("array<string>")),
        "mode": F.when(verdict == "revise", F.when(research, "research").otherwise("redraft"))})


def instructions(support: DataFrame, agreements: DataFrame) -> DataFrame:
    """What a revision is told about each disputed quote and status, defect only."""
    quotes, statuses = disputed(support, agreements)
    told = F.concat(
        F.lit("relevant_quotes["), F.col("quote_index").cast("string"), F.lit("] does not carry sub-requirement "), "sub_id",
        F.lit(": a reader of that passage alone found it "), "support")
    rated = F.concat(F.lit("the status of sub-requirement "), "sub_id", F.lit(" is "), F.replace("agreement", F.lit("_"), F.lit(" ")), F.lit(" for the language quoted"))
    return quotes.select(*KEY, "pos", told.alias("instruction")).unionByName(statuses.select(*KEY, "pos", rated.alias("instruction")))


def best_round(candidates: DataFrame) -> DataFrame:
    """Per draft the round with fewest open errors, then the higher critic, then the later."""
    rest = [c for c in candidates.columns if c not in DRAFT]
    order = F.struct(F.col("errors"), (-F.col("critic_confidence")).alias("c"), (-F.col("round")).alias("r"))
    return candidates.groupBy(*DRAFT).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*DRAFT, "b.*")


def finalize(results: DataFrame) -> DataFrame:
    """Close out results joined with their verdict, findings and evaluator cost."""
    review = (F.col("needs_review") == 1) | (F.col("verdict") != "accept")
    scored = confidence(
        F.col("raw_confidence"), verified=F.col("verified"), claimed=F.col("claimed"), not_determined=F.col("not_determined"),
        total=F.col("total"), needs_review=review, ended_by=F.col("ended_by"), critic=F.col("critic_confidence"),
        support=F.col("support_ratio"), agreed=F.coalesce(F.col("state_agreement") == "agree", F.lit(True)))
    return results.withColumns({
        **scored, "needs_review": review, "cost_usd": F.round(F.col("cost_usd") + F.coalesce("evaluator_cost_usd", F.lit(0.0)), 6)})


def cross_criterion(gaps: DataFrame, quotes: DataFrame) -> DataFrame:
    """One note per gap: the first verified quote of another criterion that mentions it.

    ``gaps`` are missing sub-requirements with their distinctive ``terms``. The
    join is on (run, term), never all gaps against all quotes.
    """
    g = gaps.select("run_id", "criterion_id", "sub_id", F.explode("terms").alias("term"))
    q = quotes.where("verified").select(
        "run_id", F.col("criterion_id").alias("other"), "idx", "where", F.explode_outer(tx.content_terms(F.col("text"))).alias("term")).where("term IS NOT NULL")
    shared = g.join(q, ["run_id", "term"]).where(F.col("other") != F.col("criterion_id")).groupBy(
        "run_id", "criterion_id", "sub_id", "other", "idx").agg(
        F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("mentions"), F.first("where").alias("where"))
    return shared.groupBy("run_id", "criterion_id", "sub_id").agg(
        F.min_by(F.struct("other", "where", "mentions"), F.struct("other", "idx")).alias("n")).select(
        "run_id", "criterion_id", "sub_id", "n.*")


# -- runs -------------------------------------------------------------------


def totals(results: DataFrame) -> DataFrame:
    """Sums, counts and mean confidence of each run's results."""
    hit = lambda c: F.count(F.when(c, 1))
    verdict = F.col("verdict")
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("criteria"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("tool_calls").alias("tool_calls"), hit(F.col("needs_review") == 1).alias("needs_review"),
        hit(F.col("ended_by") == "cap").alias("capped"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        hit(F.col("rounds") > 0).alias("revised"), *[hit(verdict == v).alias(n) for v, n in (
            ("accept", "accepted"), ("fallback", "fallback"), ("unevaluated", "unevaluated"))],
        F.round(F.sum("evaluator_cost_usd"), 6).alias("evaluator_cost_usd"))


def select_criteria(requests: DataFrame, criteria: DataFrame) -> DataFrame:
    """Requested ids in definition order; unknown ids keep a NULL position."""
    return requests.join(criteria.select("criterion_id", "position"), "criterion_id", "left")


def skipped_criteria(selected: DataFrame, results: DataFrame) -> DataFrame:
    done = results.select("run_id", "criterion_id")
    return selected.where(F.col("position").isNotNull()).join(done, ["run_id", "criterion_id"], "left_anti")


def overview(results: DataFrame) -> DataFrame:
    """Worst state, quote counts and flagged results of each run."""
    severity = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    return results.groupBy("run_id").agg(
        F.max_by("state", severity).alias("overall_state"), F.sum("verified").alias("quotes_verified"), F.sum("claimed").alias("quotes_total"),
        F.count(F.when(F.col("needs_review") == 1, 1)).alias("flagged"))


def met_words(subs: DataFrame) -> DataFrame:
    met = F.count(F.when(F.col("status") == "met", 1)).cast("string")
    return subs.groupBy(*DRAFT).agg(F.concat_ws(" ", met, F.lit("of"), F.count(F.lit(1)).cast("string"), F.lit("met")).alias("words"))
