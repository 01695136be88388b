"""Assessment queries over drafts, quotes, findings and per-criterion rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assess
from .registry import plan

KEY = assess.KEY
NQ = r"replace(lower(trim(regexp_replace(replace(replace({}, '|', ' '), '–', '-'), '\s+', ' ', 'g'))), 'ß', 'ss')"


def _norm(column: str) -> str:
    return NQ.format(column)


def _subs(src):
    idx = F.col("pos")
    cites = F.when(F.col("cites") == 2, F.array(idx, F.lit(7))).when(F.col("cites") == 1, F.array(idx)).otherwise(F.array().cast("array<int>"))
    return src.view("draft_subs").withColumn("quote_indexes", cites)


def _criteria(src):
    dims = src.view("drafts").select("criterion_id").distinct()
    return dims.select("criterion_id", F.concat(F.lit("Question "), F.col("criterion_id").cast("string")).alias("question"),
                       F.array(F.lit("s0"), F.lit("s1")).alias("sub_ids"))


VERIFIED = f"""q AS (SELECT d.*, e.evidence_id IS NOT NULL AS known, coalesce({_norm('d.text')} <> '' AND contains({_norm('e.text')}, {_norm('d.text')}), false) AS verified
  FROM v_draft_quotes d LEFT JOIN v_evidence e ON e.run_id = d.run_id AND e.evidence_id = d.evidence_id)"""
ERRORS = f"""{VERIFIED}, qq AS (SELECT *, min(idx) OVER (PARTITION BY run_id, criterion_id, {_norm('text')}, evidence_id) AS f FROM q),
hd AS (SELECT run_id, string_agg(evidence_id, ', ' ORDER BY length(evidence_id), evidence_id) AS held FROM v_evidence GROUP BY 1),
s AS (SELECT d.*, (SELECT n_quotes FROM v_drafts x WHERE x.run_id = d.run_id AND x.criterion_id = d.criterion_id) AS n FROM v_draft_subs d),
g AS (SELECT run_id, criterion_id, list(sub_id ORDER BY sub_id) = ['s0', 's1'] AS same, count(*) FILTER (status = 'met') AS met, count(*) FILTER (status IN ('met', 'partial')) AS st, count(*) AS al FROM v_draft_subs GROUP BY 1, 2),
e AS (
 SELECT run_id, criterion_id, concat('relevant_quotes[', idx, '].evidence_id') AS path, 'unknown_evidence' AS code,
   concat('''', evidence_id, ''' is not a retrieved passage; use one of ', coalesce(held, '(none retrieved)')) AS message FROM qq LEFT JOIN hd USING (run_id) WHERE NOT known
 UNION ALL SELECT run_id, criterion_id, concat('relevant_quotes[', idx, '].text'), 'not_verbatim', concat('not verbatim in ', evidence_id, ' -- copy the exact text') FROM qq WHERE known AND NOT verified
 UNION ALL SELECT run_id, criterion_id, concat('relevant_quotes[', idx, '].text'), 'too_long', concat(length(text), ' characters; at most 300') FROM qq WHERE length(text) > 300
 UNION ALL SELECT run_id, criterion_id, concat('relevant_quotes[', idx, '].text'), 'empty', 'empty quote' FROM qq WHERE trim(text) = ''
 UNION ALL SELECT run_id, criterion_id, concat('relevant_quotes[', idx, ']'), 'duplicate', 'duplicates an earlier quote' FROM qq WHERE idx > f
 UNION ALL SELECT run_id, criterion_id, concat('sub_requirements[', pos, '].quote_indexes'), 'out_of_range',
   concat('[', CASE WHEN pos >= n THEN concat(pos, ', ') ELSE '' END, '7] are not indexes into relevant_quotes (0..', n - 1, ')') FROM s WHERE cites = 2
 UNION ALL SELECT run_id, criterion_id, concat('sub_requirements[', pos, '].quote_indexes'), 'needs_quote', concat('status ''', status, ''' needs at least one supporting quote index') FROM s WHERE cites = 0 AND status IN ('met', 'partial')
 UNION ALL SELECT run_id, criterion_id, concat('sub_requirements[', pos, '].quote_indexes'), 'unexpected_quote', concat('status ''', status, ''' must have no quote indexes') FROM s WHERE cites > 0 AND status IN ('missing', 'not_determined')
 UNION ALL SELECT run_id, criterion_id, 'compliance_question', 'not_verbatim', 'must equal the question exactly as given -- copy it, do not paraphrase' FROM v_drafts WHERE question <> concat('Question ', criterion_id)
 UNION ALL SELECT run_id, criterion_id, 'sub_requirements', 'ids', 'must contain exactly these ids, once each: s0, s1' FROM g WHERE NOT same
 UNION ALL SELECT d.run_id, d.criterion_id, 'compliance_state', 'inconsistent',
   'does not follow from the sub-requirement statuses (all met = Fully; none met or partial = Non-Compliant; otherwise Partially)' FROM v_drafts d JOIN g USING (run_id, criterion_id)
   WHERE same AND state <> CASE WHEN met = al THEN 'Fully Compliant' WHEN st > 0 THEN 'Partially Compliant' ELSE 'Non-Compliant' END
 UNION ALL SELECT run_id, criterion_id, 'rationale', 'empty', 'must not be empty' FROM v_drafts WHERE trim(rationale) = ''
 UNION ALL SELECT run_id, criterion_id, 'raw_confidence', 'range', 'must be between 0 and 1' FROM v_drafts WHERE raw_confidence < 0 OR raw_confidence > 1)"""


def _errors(src):
    return assess.validate_structure(src.view("drafts"), src.view("draft_quotes"), _subs(src), src.view("evidence"), _criteria(src))


@plan("a1_normal_quotes", sql=f"""
SELECT 'quote' AS kind, quote_id AS id, {_norm('quote')} AS normal FROM v_quotes UNION ALL SELECT 'passage', doc_id, {_norm('text')} FROM @documents""")
def a1(src):
    normal = tx.normal_quote(F.col("text")).alias("normal")
    quotes = src.view("quotes").select(F.lit("quote").alias("kind"), F.col("quote_id").alias("id"), F.col("quote").alias("text"))
    docs = src.table("documents").select(F.lit("passage").alias("kind"), F.col("doc_id").alias("id"), "text")
    return quotes.unionByName(docs).select("kind", "id", normal)


@plan("a2_quote_anywhere", sql=f"""
SELECT quote_id, doc_id AS passage_id FROM (SELECT quote_id, {_norm('quote')} AS n FROM v_quotes) JOIN (SELECT doc_id, {_norm('text')} AS h FROM @documents) ON contains(h, n) WHERE n <> ''""")
def a2(src):
    passages = src.table("documents").select(F.col("doc_id").alias("passage_id"), F.col("text").alias("passage"))
    return assess.find_quotes(src.view("quotes"), passages)


@plan("a2_quote_in_passage", sql=f"WITH {VERIFIED} SELECT run_id, criterion_id, idx, known, verified FROM q")
def a2_cited(src):
    return assess.verify_quotes(src.view("draft_quotes"), src.view("evidence")).select("run_id", "criterion_id", "idx", "known", "verified")


@plan("a3_derived_state", sql="""
SELECT run_id, criterion_id, CASE WHEN count(*) FILTER (status = 'met') = count(*) THEN 'Fully Compliant' WHEN count(*) FILTER (status IN ('met', 'partial')) > 0 THEN 'Partially Compliant'
  ELSE 'Non-Compliant' END AS implied FROM v_draft_subs GROUP BY 1, 2""")
def a3(src):
    return assess.derived_states(src.view("draft_subs"))


@plan("a4_structure_errors", sql=f"WITH {ERRORS} SELECT * FROM e")
def a4(src):
    return _errors(src)


KEPT = f"""{ERRORS}, k AS (SELECT q.*, row_number() OVER (PARTITION BY run_id, criterion_id ORDER BY idx) - 1 AS new_idx FROM q
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = q.run_id AND e.criterion_id = q.criterion_id AND starts_with(e.path, concat('relevant_quotes[', q.idx, ']'))))"""


@plan("a5_kept_quotes", sql=f"WITH {KEPT} SELECT run_id, criterion_id, idx, new_idx, verified FROM k")
def a5(src):
    kept = assess.keep_quotes(src.view("draft_quotes"), _errors(src), src.view("evidence"))
    return kept.select("run_id", "criterion_id", "idx", "new_idx", "verified")


@plan("a5_remapped", sql=f"""
WITH {KEPT} SELECT s.run_id, s.criterion_id, s.pos, coalesce(CAST(k.new_idx AS STRING), '') AS quote_indexes FROM v_draft_subs s
  LEFT JOIN k ON k.run_id = s.run_id AND k.criterion_id = s.criterion_id AND k.idx = s.pos AND s.cites > 0""")
def a5_remapped(src):
    kept = assess.keep_quotes(src.view("draft_quotes"), _errors(src), src.view("evidence"))
    return assess.remap_indexes(_subs(src), kept).select("run_id", "criterion_id", "pos", F.array_join("quote_indexes", ",").alias("quote_indexes"))


def _expected(src):
    return _criteria(src).select("criterion_id", F.explode("sub_ids").alias("sub_id"))


UNDET = """u AS (SELECT run_id, criterion_id, count(*) FILTER (status = 'not_determined') + 2 - count(*) FILTER (sub_id IN ('s0', 's1')) AS not_determined FROM v_draft_subs GROUP BY 1, 2)"""


@plan("a6_undetermined", sql=f"WITH {UNDET} SELECT run_id, criterion_id, 2 AS total, not_determined FROM u")
def a6(src):
    return assess.undetermined(src.view("drafts"), src.view("draft_subs"), _expected(src))


CONF = """x AS (SELECT *, criterion_id % 4 AS nd, 7 AS total, CASE WHEN run_id % 3 = 0 THEN (run_id % 9) / 8 END AS sup, run_id % 5 <> 0 AS agreed FROM v_criterion_results),
c AS (SELECT *, CASE WHEN critic_confidence IS NULL THEN raw_confidence ELSE least(raw_confidence, critic_confidence) END
  * coalesce(sup, CASE WHEN claimed > 0 THEN verified / claimed ELSE 1 END) * (1 - nd / total) * CASE WHEN agreed THEN 1.0 ELSE 0.6 END AS v, needs_review = 1 OR ended_by = 'cap' AS capped FROM x),
z AS (SELECT *, round(least(0.95, greatest(0.05, CASE WHEN capped THEN least(v, 0.5) ELSE v END)), 3) AS confidence FROM c)"""


def _scored(src):
    rows = src.view("criterion_results")
    sup = F.when(F.col("run_id") % 3 == 0, (F.col("run_id") % 9) / 8)
    return rows.withColumns(assess.confidence(
        F.col("raw_confidence"), verified=F.col("verified"), claimed=F.col("claimed"), not_determined=F.col("criterion_id") % 4, total=F.lit(7),
        needs_review=F.col("needs_review") == 1, ended_by=F.col("ended_by"), critic=F.col("critic_confidence"), support=sup,
        agreed=F.col("run_id") % 5 != 0))


@plan("a7_confidence", sql=f"""
WITH {CONF} SELECT run_id, criterion_id, confidence, CASE WHEN critic_confidence IS NULL THEN 4 ELSE 6 END AS n_components,
  round(coalesce(sup, CASE WHEN claimed > 0 THEN verified / claimed ELSE 1 END), 3) AS quote_term, CASE WHEN capped THEN 0.5 ELSE 1.0 END AS cap FROM z""")
def a7(src):
    return _scored(src).select(
        "run_id", "criterion_id", "confidence", F.size("components").alias("n_components"),
        F.element_at("components", "quote_term").alias("quote_term"), F.element_at("components", "cap").alias("cap"))


@plan("a8_buckets", sql=f"""
WITH {CONF} SELECT CASE WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS bucket, count(*) AS n FROM z GROUP BY 1""")
def a8(src):
    return _scored(src).groupBy(assess.bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


SUPPORTS = ("supports", "partial", "irrelevant", "contradicts")
AGREES = ("agree", "too_strong", "too_weak")


def _findings(src):
    """The findings as flat tables: header, quote support, status agreement, gaps."""
    f = src.view("findings")
    key = F.col("l_partkey") + F.col("l_suppkey")

    def exploded(n: str):
        return f.where(F.col(n) > 0).select(*KEY, "l_partkey", "l_suppkey", key.alias("h"), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("pos"))

    def pick(words, seed):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (seed % len(words) + 1).cast("int"))

    pos = F.col("pos")
    support = exploded("n_support").select(
        *KEY, "pos", (pos + F.col("h") % 3 - 1).cast("int").alias("quote_index"), F.concat(F.lit("s"), ((F.col("h") + pos) % 4).cast("string")).alias("sub_id"),
        pick(SUPPORTS, F.col("h") + pos).alias("support"))
    agreements = exploded("n_status").select(
        *KEY, "pos", F.concat(F.lit("s"), ((F.col("l_suppkey") + pos) % 3).cast("string")).alias("sub_id"),
        pick(AGREES, F.col("l_partkey") + pos).alias("agreement"))
    missing = exploded("n_missing").select(*KEY, "pos", F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("sub_id"))
    return f, support, agreements, missing


FIND = """sup AS (SELECT run_id, criterion_id, round, pos, CAST(pos + (l_partkey + l_suppkey) % 3 - 1 AS INT) AS quote_index, concat('s', (l_partkey + l_suppkey + pos) % 4) AS sub_id,
  (['supports', 'partial', 'irrelevant', 'contradicts'])[(l_partkey + l_suppkey + pos) % 4 + 1] AS support FROM (SELECT *, unnest(range(0, n_support)) AS pos FROM v_findings)),
agr AS (SELECT run_id, criterion_id, round, pos, concat('s', (l_suppkey + pos) % 3) AS sub_id, (['agree', 'too_strong', 'too_weak'])[(l_partkey + pos) % 3 + 1] AS agreement
  FROM (SELECT *, unnest(range(0, n_status)) AS pos FROM v_findings)),
mis AS (SELECT run_id, criterion_id, round, 0 AS pos, concat('s', l_suppkey % 5) AS sub_id FROM v_findings WHERE n_missing = 1),
kn AS (SELECT run_id, line AS criterion_id, unnest(['s0', 's1', 's2']) AS sub_id, unnest(['met', 'partial', 'missing']) AS status FROM v_criterion_rows)"""


def _known(src):
    rows = src.view("findings").select("run_id", "criterion_id")
    return rows.select("run_id", "criterion_id", F.inline(F.array(*[
        F.struct(F.lit(s).alias("sub_id"), F.lit(v).alias("status")) for s, v in (("s0", "met"), ("s1", "partial"), ("s2", "missing"))])))


@plan("a9_support_ratio", sql=f"""
WITH {FIND} SELECT f.run_id, f.criterion_id, f.round, round(coalesce(avg(CASE support WHEN 'supports' THEN 1.0 WHEN 'partial' THEN CASE WHEN status = 'partial' THEN 1.0 ELSE 0.5 END WHEN 'irrelevant' THEN 0 WHEN 'contradicts' THEN 0 END), 1), 6) AS support_ratio
  FROM v_findings f LEFT JOIN sup USING (run_id, criterion_id, round) LEFT JOIN kn ON kn.run_id = f.run_id AND kn.criterion_id = f.criterion_id AND kn.sub_id = sup.sub_id GROUP BY 1, 2, 3""")
def a9(src):
    f, support, _, _ = _findings(src)
    ratio = assess.support_ratio(support, _known(src))
    return f.select(*KEY).join(ratio, KEY, "left").select(*KEY, F.round(F.coalesce("support_ratio", F.lit(1.0)), 6).alias("support_ratio"))


HEDGES = ", ".join(f"CASE WHEN regexp_matches(n, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{t}' END" for t in tx.HEDGES)


@plan("a10_hedges", sql=f"""
SELECT kind, id, array_to_string(list_filter([{HEDGES}], lambda x: x IS NOT NULL), ',') AS hedges FROM (
  SELECT 'quote' AS kind, run_id * 100 + criterion_id * 10 + idx AS id, {_norm('text')} AS n FROM v_draft_quotes UNION ALL SELECT 'document', doc_id, {_norm('text')} FROM @documents)""")
def a10(src):
    quotes = src.view("draft_quotes").select(F.lit("quote").alias("kind"), (F.col("run_id") * 100 + F.col("criterion_id") * 10 + F.col("idx")).alias("id"), "text")
    docs = src.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    hedges = tx.hedge_terms(tx.normal_quote(F.col("text")))
    return quotes.unionByName(docs).select("kind", "id", F.array_join(hedges, ",").alias("hedges"))


STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def _terms(text: str) -> str:
    one = r"regexp_replace(w, '^(.{3,}[^s])s$', '\1')"
    stem = rf"CASE WHEN regexp_matches({one}, '^.{{4,}}(?:ing|ion|ed)$') THEN regexp_replace({one}, '(?:ing|ion|ed)$', '') ELSE regexp_replace({one}, '^(.{{4,}})e$', '\1') END"
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({STOP})), lambda w: {stem}))"


@plan("a11_content_terms", sql=f"""
SELECT kind, id, len(t) AS n, md5(array_to_string(list_sort(t), ',')) AS digest FROM (SELECT 'quote' AS kind, quote_id AS id, {_terms('quote')} AS t FROM v_quotes
  UNION ALL SELECT 'document', doc_id, {_terms('text')} FROM @documents)""")
def a11(src):
    quotes = src.view("quotes").select(F.lit("quote").alias("kind"), F.col("quote_id").alias("id"), F.col("quote").alias("text"))
    docs = src.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    rows = quotes.unionByName(docs).select("kind", "id", tx.content_terms(F.col("text")).alias("t"))
    return rows.select("kind", "id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), ",")).alias("digest"))


DISTINCT = f"""tm AS (SELECT criterion_id, sub_id, p_partkey, unnest({_terms('requirement')}) AS term, {_terms('criterion_requirement')} AS cr FROM v_subparts),
tn AS (SELECT *, count(*) OVER (PARTITION BY criterion_id, term) = 1 AND NOT list_contains(cr, term) AS own FROM tm),
dt AS (SELECT criterion_id, sub_id, any_value(p_partkey) AS p_partkey, CASE WHEN count(*) FILTER (own) > 0 THEN list(term ORDER BY term) FILTER (own) ELSE list(term ORDER BY term) END AS terms FROM tn GROUP BY 1, 2)"""


@plan("a12_distinctive_terms", sql=f"WITH {DISTINCT} SELECT criterion_id, sub_id, array_to_string(terms, ',') AS terms FROM dt")
def a12(src):
    return assess.distinctive_terms(src.view("subparts")).select("criterion_id", "sub_id", F.array_join("terms", ",").alias("terms"))


@plan("a13_unsearched", sql=f"""
WITH {DISTINCT}, qs AS (SELECT DISTINCT p_partkey % 40 AS run_id, unnest({_terms("concat(p_name, ' size', p_size)")}) AS term FROM @part WHERE p_partkey % 3 = 1)
SELECT p_partkey % 40 AS run_id, criterion_id, sub_id FROM dt WHERE p_partkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM qs WHERE qs.run_id = dt.p_partkey % 40 AND list_contains(dt.terms, qs.term))""")
def a13(src):
    subs = src.view("subparts")
    run = (F.col("p_partkey") % 40).alias("run_id")
    missing = subs.where(F.col("p_partkey") % 3 == 0).select(run, "criterion_id", "sub_id")
    queries = src.table("part").where(F.col("p_partkey") % 3 == 1).select(run, F.concat("p_name", F.lit(" size"), F.col("p_size").cast("string")).alias("query"))
    return assess.unsearched(missing, assess.distinctive_terms(subs), queries)


@plan("a14_precheck", sql=f"""
SELECT q.run_id, q.criterion_id, q.idx, CASE WHEN s.cites > 0 AND s.status IN ('met', 'partial') THEN array_to_string(list_filter([{HEDGES.replace('(n,', '(' + _norm('q.text') + ',')}], lambda x: x IS NOT NULL), ',') ELSE '' END AS hedges
  FROM v_draft_quotes q LEFT JOIN v_draft_subs s ON s.run_id = q.run_id AND s.criterion_id = q.criterion_id AND s.pos = q.idx""")
def a14(src):
    out = assess.precheck(src.view("draft_quotes"), _subs(src))
    return out.select("run_id", "criterion_id", "idx", F.array_join("hedge_terms", ",").alias("hedges"))


@plan("a15_findings_errors", sql=f"""
WITH {FIND}, nq AS (SELECT run_id, line AS criterion_id, CAST(l_partkey % 3 AS INT) AS n FROM v_criterion_rows),
ra AS (SELECT *, min(pos) OVER (PARTITION BY run_id, criterion_id, round, sub_id) AS f FROM agr)
SELECT run_id, criterion_id, round, concat('quote_support[', pos, '].quote_index') AS path, 'out_of_range' AS code FROM sup JOIN nq USING (run_id, criterion_id) WHERE quote_index < 0 OR quote_index >= n
UNION ALL SELECT run_id, criterion_id, round, concat('quote_support[', pos, '].sub_requirement_id'), 'unknown_sub_requirement' FROM sup WHERE sub_id NOT IN ('s0', 's1', 's2')
UNION ALL SELECT run_id, criterion_id, round, concat('status_agreement[', pos, '].sub_requirement_id'), 'unknown_sub_requirement' FROM agr WHERE sub_id NOT IN ('s0', 's1', 's2')
UNION ALL SELECT run_id, criterion_id, round, concat('status_agreement[', pos, ']'), 'duplicate' FROM ra WHERE sub_id IN ('s0', 's1', 's2') AND pos > f
UNION ALL SELECT run_id, criterion_id, round, 'missing_searches', 'unknown_sub_requirement' FROM mis WHERE sub_id NOT IN ('s0', 's1', 's2')
UNION ALL SELECT run_id, criterion_id, round, 'critic_confidence', 'range' FROM v_findings WHERE critic_confidence < 0 OR critic_confidence > 1""")
def a15(src):
    f, support, agreements, missing = _findings(src)
    counts = f.select("run_id", "criterion_id", (F.col("l_partkey") % 3).cast("int").alias("n_quotes"))
    return assess.validate_findings(f, support, agreements, missing, counts, _known(src))


@plan("a16_merged_gaps", sql="""
SELECT run_id, criterion_id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN l_partkey % 2 = 0 THEN ['s2', 's0'] ELSE ['s1'] END, CASE WHEN l_suppkey % 2 = 0 THEN ['s0', 's3'] ELSE [] END))), ',') AS gaps FROM v_findings""")
def a16(src):
    a = F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("s2"), F.lit("s0"))).otherwise(F.array(F.lit("s1")))
    b = F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("s0"), F.lit("s3"))).otherwise(F.array().cast("array<string>"))
    return src.view("findings").select("run_id", "criterion_id", F.array_join(assess.merge_gaps(a, b), ",").alias("gaps"))


@plan("a17_disputed", sql=f"""
WITH {FIND} SELECT run_id, criterion_id, round, pos, concat('quote ', support) AS what FROM sup WHERE support IN ('irrelevant', 'contradicts')
UNION ALL SELECT run_id, criterion_id, round, pos, concat('status ', agreement) FROM agr WHERE agreement <> 'agree'""")
def a17(src):
    _, support, agreements, _ = _findings(src)
    quotes, statuses = assess.disputed(support, agreements)
    return quotes.select(*KEY, "pos", F.concat(F.lit("quote "), "support").alias("what")).unionByName(
        statuses.select(*KEY, "pos", F.concat(F.lit("status "), "agreement").alias("what")))


DECIDE = f"""{FIND}, rs AS (SELECT run_id, criterion_id, round, 1 AS o, pos, concat('quote_', support) AS reason FROM sup WHERE support IN ('irrelevant', 'contradicts')
 UNION ALL SELECT run_id, criterion_id, round, 2, pos, concat('status_', agreement) FROM agr WHERE agreement <> 'agree'
 UNION ALL SELECT run_id, criterion_id, round, 3, 0, 'state_disagreement' FROM v_findings WHERE state_agreement = 'disagree'
 UNION ALL SELECT run_id, criterion_id, round, 4, pos, 'unsearched_requirement' FROM mis),
rl AS (SELECT run_id, criterion_id, round, string_agg(reason, ',' ORDER BY o, pos) AS reasons FROM rs GROUP BY 1, 2, 3),
de AS (SELECT f.run_id, f.criterion_id, f.round, coalesce(reasons, '') AS reasons, CASE WHEN reasons IS NULL THEN 'accept' WHEN f.round >= 1 THEN 'fallback' ELSE 'revise' END AS verdict,
  CASE WHEN reasons IS NOT NULL AND f.round < 1 THEN CASE WHEN n_missing > 0 THEN 'research' ELSE 'redraft' END END AS mode FROM v_findings f LEFT JOIN rl USING (run_id, criterion_id, round))"""


@plan("a18_decisions", sql=f"WITH {DECIDE} SELECT * FROM de")
def a18(src):
    out = assess.decide(*_findings(src))
    return out.select(*KEY, F.array_join("reasons", ",").alias("reasons"), "verdict", "mode")


@plan("a19_best_round", sql="""
SELECT run_id, criterion_id, round, critic_confidence, errors FROM (SELECT run_id, line % 2 AS criterion_id, line AS round, (l_partkey % 64) / 64 AS critic_confidence, l_suppkey % 3 AS errors FROM v_criterion_rows)
 QUALIFY row_number() OVER (PARTITION BY run_id, criterion_id ORDER BY errors, critic_confidence DESC, round DESC) = 1""")
def a19(src):
    rounds = src.view("criterion_rows").select(
        "run_id", (F.col("line") % 2).alias("criterion_id"), F.col("line").alias("round"), ((F.col("l_partkey") % 64) / 64).alias("critic_confidence"),
        (F.col("l_suppkey") % 3).alias("errors"))
    return assess.best_round(rounds).select("run_id", "criterion_id", "round", "critic_confidence", "errors")


@plan("a20_finalize", sql=f"""
WITH {DECIDE}, {CONF.replace("needs_review = 1 OR ended_by", "needs_review = 1 OR dverdict <> 'accept' OR ended_by").replace("FROM v_criterion_results)", "FROM (SELECT r.* EXCLUDE (verdict), de.verdict AS dverdict, f.state_agreement FROM v_criterion_results r JOIN de USING (run_id, criterion_id) JOIN v_findings f USING (run_id, criterion_id)))").replace("run_id % 5 <> 0 AS agreed", "state_agreement = 'agree' AS agreed")}
SELECT run_id, criterion_id, dverdict AS verdict, confidence, needs_review = 1 OR dverdict <> 'accept' AS needs_review, round(cost_usd + coalesce(evaluator_cost_usd, 0), 6) AS cost_usd FROM z""")
def a20(src):
    decided = assess.decide(*_findings(src)).select("run_id", "criterion_id", "verdict", "state_agreement")
    rows = src.view("criterion_results").drop("verdict").join(decided, ["run_id", "criterion_id"]).withColumns({
        "not_determined": F.col("criterion_id") % 4, "total": F.lit(7), "support_ratio": F.when(F.col("run_id") % 3 == 0, (F.col("run_id") % 9) / 8)})
    return assess.finalize(rows).select("run_id", "criterion_id", "verdict", "confidence", "needs_review", "cost_usd")


@plan("a21_cited_passages", sql="""
SELECT DISTINCT q.run_id, q.criterion_id, q.evidence_id, e.section, e.text FROM v_draft_quotes q JOIN v_evidence e ON e.run_id = q.run_id AND e.evidence_id = q.evidence_id""")
def a21(src):
    return assess.cited_passages(src.view("draft_quotes"), src.view("evidence")).select("run_id", "criterion_id", "evidence_id", "section", "text")


@plan("a21_search_queries", sql="""
SELECT event_id AS seq, 'query' AS name, event_type AS query FROM @events WHERE event_type <> 'error' UNION ALL SELECT event_id, 'prefix', CAST(user_id AS STRING) FROM @events WHERE user_id % 2 = 0""")
def a21_queries(src):
    prefix = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(" ")
    query = F.when(F.col("event_type") != "error", F.col("event_type"))
    args = F.create_map(F.lit("query"), query, F.lit("prefix"), prefix, F.lit("top_k"), F.lit("5"), F.lit("mode"), F.lit("hybrid"))
    calls = src.table("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), args.alias("args"))
    return assess.search_queries(calls).select("seq", "name", "query")


@plan("a22_cross_criterion", sql=f"""
WITH {VERIFIED}, tm AS (SELECT run_id, criterion_id, sub_id, status, unnest({_terms('requirement')}) AS term FROM v_draft_subs),
tn AS (SELECT *, count(*) OVER (PARTITION BY run_id, criterion_id, term) = 1 AS own FROM tm),
dt AS (SELECT run_id, criterion_id, sub_id, status, CASE WHEN count(*) FILTER (own) > 0 THEN list(term) FILTER (own) ELSE list(term) END AS terms FROM tn GROUP BY 1, 2, 3, 4),
g AS (SELECT run_id, criterion_id, sub_id, unnest(terms) AS term FROM dt WHERE status = 'missing'),
qt AS (SELECT q.run_id, q.criterion_id AS other, q.idx, s.p_name AS nm, unnest({_terms("concat(s.p_name, ' ', q.text)")}) AS term FROM q JOIN v_draft_rows s ON s.run_id = q.run_id AND s.criterion_id = q.criterion_id AND s.idx = q.idx WHERE verified),
sh AS (SELECT g.run_id, criterion_id, sub_id, other, idx, any_value(nm) AS "where", string_agg(DISTINCT g.term, ', ' ORDER BY g.term) AS mentions FROM g JOIN qt ON qt.run_id = g.run_id AND qt.term = g.term AND other <> criterion_id GROUP BY 1, 2, 3, 4, 5)
SELECT run_id, criterion_id, sub_id, other, "where", mentions FROM sh QUALIFY row_number() OVER (PARTITION BY run_id, criterion_id, sub_id ORDER BY other, idx) = 1""")
def a22(src):
    subs = src.view("draft_subs")
    scoped = subs.select(F.struct("run_id", "criterion_id").alias("criterion_id"), "sub_id", "requirement", F.lit("").alias("criterion_requirement"))
    terms = assess.distinctive_terms(scoped).select("criterion_id.*", "sub_id", "terms")
    gaps = terms.join(subs.where("status = 'missing'").select("run_id", "criterion_id", "sub_id"), ["run_id", "criterion_id", "sub_id"])
    names = src.view("draft_rows").select("run_id", "criterion_id", "idx", F.col("p_name").alias("where"))
    quotes = assess.verify_quotes(src.view("draft_quotes"), src.view("evidence")).join(names, ["run_id", "criterion_id", "idx"])
    return assess.cross_criterion(gaps, quotes.withColumn("text", F.concat_ws(" ", "where", "text")))


@plan("a23_totals", sql=f"""
WITH {CONF} SELECT run_id, count(*) AS criteria, round(sum(cost_usd), 6) AS cost_usd, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(tool_calls) AS tool_calls,
  count(*) FILTER (needs_review = 1) AS needs_review, count(*) FILTER (ended_by = 'cap') AS capped, round(avg(raw_confidence), 4) AS mean_confidence, count(*) FILTER (rounds > 0) AS revised,
  count(*) FILTER (verdict = 'accept') AS accepted, count(*) FILTER (verdict = 'fallback') AS fallback, count(*) FILTER (verdict = 'unevaluated') AS unevaluated, round(sum(evaluator_cost_usd), 6) AS evaluator_cost_usd FROM z GROUP BY 1""")
def a23(src):
    return assess.totals(src.view("criterion_results").withColumn("confidence", F.col("raw_confidence")))


@plan("a24_record_criteria", sql="""
SELECT run_id, criterion_id, state, raw_confidence, needs_review, ended_by, cost_usd, claimed AS quotes_total, least(verified, claimed) AS quotes_verified FROM v_criterion_results""")
def a24(src):
    reports = assess.pack_reports(src.view("criterion_results")).select("run_id", "report_json")
    return assess.record_criteria(assess.unpack_reports(reports))


@plan("a25_select_criteria", sql="""
WITH r AS (SELECT run_id, CASE WHEN l_partkey % 19 = 0 THEN line + 90 ELSE line END AS criterion_id, l_suppkey FROM v_criterion_rows)
SELECT run_id, criterion_id, CASE WHEN criterion_id < 90 THEN 7 - criterion_id END AS position, CASE WHEN criterion_id >= 90 THEN 'unknown' WHEN l_suppkey % 8 = 0 THEN 'skipped' ELSE 'done' END AS outcome FROM r""")
def a25(src):
    rows = src.view("criterion_rows")
    requests = rows.select("run_id", F.when(F.col("l_partkey") % 19 == 0, F.col("line") + 90).otherwise(F.col("line")).alias("criterion_id"), "l_suppkey")
    criteria = rows.select(F.col("line").alias("criterion_id")).distinct().withColumn("position", 7 - F.col("criterion_id"))
    selected = assess.select_criteria(requests, criteria)
    skipped = assess.skipped_criteria(selected, requests.where(F.col("l_suppkey") % 8 != 0)).select("run_id", "criterion_id", F.lit(True).alias("skipped"))
    outcome = F.when(F.col("position").isNull(), "unknown").when(F.col("skipped"), "skipped").otherwise("done")
    return selected.join(skipped, ["run_id", "criterion_id"], "left").select("run_id", "criterion_id", "position", outcome.alias("outcome"))


@plan("a26_overview", sql="""
SELECT run_id, CASE max(CASE state WHEN 'Fully Compliant' THEN 1 WHEN 'Partially Compliant' THEN 2 ELSE 3 END) WHEN 1 THEN 'Fully Compliant' WHEN 2 THEN 'Partially Compliant' ELSE 'Non-Compliant' END AS overall_state,
  sum(verified) AS quotes_verified, sum(claimed) AS quotes_total, count(*) FILTER (needs_review = 1) AS flagged FROM v_criterion_results GROUP BY 1""")
def a26(src):
    return assess.overview(src.view("criterion_results"))


@plan("a26_met_words", sql="SELECT run_id, criterion_id, concat(count(*) FILTER (status = 'met'), ' of ', count(*), ' met') AS words FROM v_draft_subs GROUP BY 1, 2")
def a26_words(src):
    return assess.met_words(src.view("draft_subs"))
