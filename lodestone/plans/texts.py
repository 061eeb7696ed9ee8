"""Queries of the scalar text functions and guards over documents and conversations, with neutral word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import guards, lists, text
from lodestone.operators import verify
from lodestone.runtime import spread, table

STOP = ("the", "of", "and", "to", "in", "la", "le", "de", "die", "der", "und", "el", "que", "en")
SLOTS = lists.SlotRules(
    intents=(("ask", ("what", "queque", "einch")), ("tell", ("that the", "que la", "die der")), ("name", ("the", "de", "und"))),
    paper_words=("thth",), action_words=("tion",), procedures=(("plan", ("ingeres", "eaument")), ("form", ("ereth", "ellepa", "keit"))), procedure_patterns=(),
    locations=(("north", ("onthe", "anou")), ("south", ("ereau", "verge"))), methods=(("online", ("with",)), ("desk", ("pour", "mit"))),
    documents=(("card", ("thand", "ment")), ("sheet", ("heon", "eaux")), ("book", ("ndere", "lich"))), fees=(), times=(), applicants=(("person", ("hean", "vient")),),
)
HIGH = (("first", ("the", "la")), ("second", ("und", "el")))
MEDIUM = (("third", ("of", "de", "mit")),)


def text_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.md5(text.fold_vowels(F.col("text"))).alias("vowels_md5"), F.md5(text.fold_marks(F.col("text"))).alias("marks_md5"), F.md5(text.canonical(F.col("text"))).alias("canonical_md5"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are cut into tokens once, and once more without what isn't meaningful; the sets are made of the distinct ones."""
    d, t = spread(table(spark, sf_dir, "documents")), F.col("text")
    n = lambda c: F.size(c).cast("long")
    d = d.select("doc_id", text.tokens(t).alias("w"), text.meaningful_tokens(t, STOP).alias("m")).withColumn("u", F.array_distinct("w"))
    return d.select(
        "doc_id", n("w").alias("n_tokens"), n(text.subject_of(F.col("u"), STOP)).alias("n_subject"), n("m").alias("n_meaningful"), n(text.distinctive_of(F.col("u"), STOP)).alias("n_distinctive"),
        n(F.array_distinct(text.pairs_of(F.col("m")))).alias("n_pairs"),
    )


def number_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.array_join(F.array_sort(text.numbers(F.col("text"))), " ").alias("numbers"))


def number_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a claim, with the document before it as evidence: whether it has numbers that the other hasn't."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", text.numbers(F.col("text")).alias("n"))
    both = d.join(d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("n").alias("before")), "doc_id")
    return both.select("doc_id", verify.number_conflict(F.col("n"), F.col("before")).alias("conflict"))


def claim_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.claims(F.col("text"))
    d = spread(table(spark, sf_dir, "documents")).withColumn("c", c)
    return d.select("doc_id", F.size("c").cast("long").alias("n_claims"), F.md5(F.array_join("c", "\n")).alias("claims_md5"), F.size(text.claim_lines(F.col("c"), STOP)).cast("long").alias("n_lines"), F.size(text.list_items(F.col("text"), STOP)).cast("long").alias("n_items"))


def guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    d = spread(table(spark, sf_dir, "documents")).withColumn("n", guards.sensitive_counts(t))
    return d.select("doc_id", *[F.col(f"n.{k}").cast("long").alias(k) for k in ("long_ids", "short_ids", "phones", "emails")], guards.has_sensitive(t).alias("sensitive"), F.coalesce(guards.input_guard(t), F.lit("ok")).alias("guard"))


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    clean = guards.output_guard(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "strict").otherwise("friendly"), "Checked by hand.", F.substring_index("text", "\n", 1))
    return d.select("doc_id", clean.alias("clean"), guards.mask(F.col("text")).alias("masked"))


def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    r = guards.risk(F.col("text"), ("with",), HIGH, MEDIUM)
    rows = c.select("conv_id", "turn", "text", r.alias("r"))
    return rows.select(
        "conv_id", "turn", F.col("r.level").alias("level"), F.array_join("r.reasons", ",").alias("reasons"), guards.mode(F.lit("friendly"), F.col("r.force_strict")).alias("mode"),
        guards.refuses(F.col("r.reasons"), F.col("text"), ("thing",), ("first",)).alias("refused"),
    )


def question_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    patterns = (("docs", "thing|lich"), ("fee", "tion"), ("time", "ment|ing"))
    low = F.col("text")
    place = guards.unsupported_place(low, ("onthe", "verge"), ("the", "la"), ("la", "und"))
    return c.select(
        "conv_id", "turn", F.array_join(text.requested_fields(low, patterns, None, ()), ",").alias("fields"), text.numbers_known(low, F.concat(F.lit("1 2 3"), F.col("role"))).alias("numbers_known"),
        text.is_vague(low, ("tion",), ("the",), ("hello",), ("und", "la"), "^$", patterns).alias("vague"), place.alias("unsupported_place"),
        text.is_negated(F.lit("the"), low, ("of", "in", "by"), ("any",)).alias("negated"), text.is_useless(low, "none", 40).alias("useless"),
        text.search_text(F.substring_index(low, " ", 3), (("role", F.col("role")), ("turn", F.col("turn").cast("string"))), ()).alias("search_text"),
    )


def message_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.slots(F.col("text"), SLOTS)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("s"))
    return rows.select("conv_id", "turn", *[F.col(f"s.{k}").alias(k) for k in ("intent", "procedure_name", "location", "method", "applicant_type")], F.array_join("s.documents", ",").alias("documents"))


def _in(words: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_BARE = "regexp_replace(regexp_replace({}, '(?i)\\[?EC_\\d{{3}}\\]?', ' ', 'g'), '(?:^|\\n)\\s*(?:-\\s*)?\\d+[.)]\\s+', ' ', 'g')"
FROM, TO = "".join(text.VOWELS), "".join(text.VOWELS.values())


def meaningful_sql(c: str) -> str:
    return f"list_filter({TOKENS.format(_BARE.format(c))}, lambda x: x NOT IN {_in(STOP)})"


def subject_sql(c: str) -> str:
    base = f"list_filter({TOKENS.format(c)}, lambda x: x NOT IN {_in(STOP)} AND length(x) > 1)"
    return f"list_distinct(list_concat({base}, list_transform({base}, lambda x: translate(lower(x), '{FROM}', '{TO}'))))"


def distinctive_sql(c: str) -> str:
    folded = f"translate(lower(trim({c})), '{FROM}', '{TO}')"
    return f"list_distinct(list_filter({TOKENS.format(folded)}, lambda x: x NOT IN {_in(STOP)} AND length(x) > 1))"


def _rule(rules: tuple, c: str = "f") -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains({c}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{label}'" for label, words in rules)
    return f"CASE {whens} END"


_CLAIMS = f"""(SELECT doc_id, list(CASE WHEN mark IS NOT NULL THEN mark || ' ' || x ELSE x END ORDER BY i) FILTER (NOT bare) AS c FROM (
  SELECT doc_id, i, x, bare, CASE WHEN lag(bare) OVER w THEN lag(x) OVER w END AS mark FROM (
    SELECT doc_id, i, x, regexp_matches(x, '^(?:-\\s*)?\\d{{1,2}}[.)]$') AS bare FROM (
      SELECT doc_id, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS x, generate_subscripts(p, 1) AS i FROM (
        SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS p FROM documents)) WHERE x <> '')
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id)"""
_M = meaningful_sql("x")
_ITEMS = "list_transform(string_split_regex(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '(^|\\s)\\d{1,2}[.)]\\s+', '\\1' || chr(10), 'g'), '\\n+|;'), lambda x: regexp_replace(x, '^[ \\-+*\\t]+|[ \\-+*\\t]+$', '', 'g'))"

QUERIES = {
    "text_folds": text_folds, "token_counts": token_counts, "number_sets": number_sets, "number_conflicts": number_conflicts, "claim_lists": claim_lists, "guard_counts": guard_counts, "redaction": redaction, "risk_levels": risk_levels,
    "question_fields": question_fields, "message_slots": message_slots,
}

_R = "(SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM conversations)"
_HAS = lambda words: " OR ".join(f"list_contains(w, '{x}')" for x in words)
ORACLES = {
    "text_folds": f"""SELECT doc_id, md5(translate(lower(text), '{FROM}', '{TO}')) AS vowels_md5, md5(strip_accents(lower(text))) AS marks_md5,
        md5(trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g'))) AS canonical_md5 FROM documents""",
    "token_counts": f"""SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len({subject_sql('text')}) AS n_subject, len({meaningful_sql('text')}) AS n_meaningful, len({distinctive_sql('text')}) AS n_distinctive,
        len(list_distinct(list_transform(range(1, len({meaningful_sql('text')})), lambda i: ({meaningful_sql('text')})[i] || ' ' || ({meaningful_sql('text')})[i + 1]))) AS n_pairs FROM documents""".replace(
        f"len(list_distinct(list_transform(range(1, len({meaningful_sql('text')})), lambda i: ({meaningful_sql('text')})[i] || ' ' || ({meaningful_sql('text')})[i + 1]))) AS n_pairs FROM documents",
        f"(SELECT count(DISTINCT m[i] || ' ' || m[i + 1]) FROM (SELECT m, unnest(range(1, len(m))) AS i FROM (SELECT {meaningful_sql('text')} AS m))) AS n_pairs FROM documents",
    ),
    "number_sets": """SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '(?i)\\[?EC_\\d{3}\\]?', '', 'g'),
        '(?:^|\\n)\\s*(?:-\\s*)?\\d+[.)]\\s+', ' ', 'g'), '(?:^|[^\\p{L}\\p{N}_])(\\d+(?:[.,]\\d+)*)', 1), lambda x: regexp_replace(regexp_replace(x, '[.,]', '', 'g'), '^0+(\\d)', '\\1')))), ' '), '') AS numbers FROM documents""",
    "claim_lists": f"""SELECT d.doc_id, coalesce(len(c), 0) AS n_claims, md5(coalesce(array_to_string(c, chr(10)), '')) AS claims_md5,
        coalesce(len(list_filter(c, lambda x: NOT regexp_matches(x, '(?i)^[^\\p{{L}}\\p{{N}}_]*(\\[?EC_\\d+\\]?[^\\p{{L}}\\p{{N}}_]*)*(\\[?xxx\\]?[^\\p{{L}}\\p{{N}}_]*)*$')
          AND NOT (ends_with(trim(x), ':') AND len({_M}) <= 8) AND len({_M}) > 0)), 0) AS n_lines,
        len(list_filter({_ITEMS}, lambda x: len({_M}) >= 2)) AS n_items FROM documents d LEFT JOIN {_CLAIMS} USING (doc_id)""",
    "guard_counts": """WITH c AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM documents),
        n AS (SELECT doc_id, text, len(list_filter(w, lambda x: regexp_matches(x, '^\\d{12}$'))) AS long_ids, len(list_filter(regexp_extract_all(text, '\\d+'), lambda x: length(x) = 9)) AS short_ids,
          len(list_filter(w, lambda x: regexp_matches(x, '^0\\d{9,10}$'))) AS phones, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails FROM c)
        SELECT doc_id, long_ids, short_ids, phones, emails, long_ids + short_ids + phones + emails > 0 AS sensitive, CASE WHEN trim(text) = '' THEN 'empty_input' ELSE 'ok' END AS guard FROM n""",
    "risk_levels": f"""SELECT conv_id, turn, CASE WHEN h <> '' THEN 'high' WHEN m <> '' THEN 'medium' ELSE 'low' END AS level, CASE WHEN h <> '' THEN h ELSE m END AS reasons,
        CASE WHEN h <> '' THEN 'strict' ELSE 'friendly' END AS mode, h LIKE 'first%' AND contains(lower(text), 'thing') AS refused FROM (SELECT *,
        concat_ws(',', CASE WHEN {_HAS(HIGH[0][1])} THEN 'first' END, CASE WHEN {_HAS(HIGH[1][1])} THEN 'second' END, CASE WHEN {_HAS(('with',))} THEN 'domain_risk:with' END) AS h,
        CASE WHEN {_HAS(MEDIUM[0][1])} THEN 'third' ELSE '' END AS m FROM {_R})""",
    "question_fields": f"""WITH b AS (SELECT *, lower(trim(text)) AS l, translate(lower(trim(text)), '{FROM}', '{TO}') AS f, role FROM (SELECT c.role, r.* FROM {_R} r JOIN conversations c USING (conv_id, turn))),
        k AS (SELECT *, list_filter(w, lambda x: x <> 'the') AS bw, trim(regexp_replace(trim(array_to_string(list_transform(string_split_regex(' ' || l || ' ', '\\s+'), lambda x: CASE WHEN regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]', '', 'g') = 'the'
          THEN regexp_replace(x, '[\\p{{L}}\\p{{N}}_]', '', 'g') ELSE x END), ' ')), '\\s+', ' ', 'g')) AS c,
          regexp_matches(text, '(?i)thing|lich') AS p1, regexp_matches(text, '(?i)tion') AS p2, regexp_matches(text, '(?i)ment|ing') AS p3 FROM b)
        SELECT conv_id, turn, concat_ws(',', CASE WHEN p1 THEN 'docs' END, CASE WHEN p2 THEN 'fee' END, CASE WHEN p3 THEN 'time' END) AS fields,
        len(list_filter(regexp_extract_all(text, '\\d+'), lambda x: NOT contains('1 2 3' || role, x))) = 0 AS numbers_known,
        l = '' OR (NOT contains(l, 'tion') AND (l = 'hello' OR starts_with(c, 'und') OR starts_with(c, 'la') OR starts_with(l, 'und') OR starts_with(l, 'la') OR c = ''
          OR (len(list_filter(string_split_regex(c, '\\s+'), lambda x: x <> '')) <= 4 AND NOT p1 AND NOT p2 AND NOT p3))) AS vague,
        NOT (contains(l, 'onthe') OR contains(l, 'verge') OR contains(f, 'onthe') OR contains(f, 'verge')) AND (list_contains(w, 'the') OR list_contains(w, 'la')
          OR list_contains(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}_]+'), 'la') OR list_contains(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}_]+'), 'und')) AS unsupported_place,
        regexp_matches(l, '(of|in|by)\\s+(any\\s+)?the') AS negated, length(trim(text)) < 40 OR lower(trim(text)) = 'none' AS useless,
        trim(array_to_string(string_split(text, ' ')[1:3], ' ')) || ' | role: ' || role || ' | turn: ' || turn AS search_text FROM k""",
    "message_slots": f"""SELECT conv_id, turn, {_rule(SLOTS.intents)} AS intent, CASE WHEN NOT (contains(f, 'thth') AND NOT contains(f, 'tion')) THEN {_rule(SLOTS.procedures)} END AS procedure_name,
        {_rule(SLOTS.locations)} AS location, {_rule(SLOTS.methods)} AS method, {_rule(SLOTS.applicants)} AS applicant_type,
        concat_ws(',', {', '.join(_rule((d,)) for d in SLOTS.documents)}) AS documents FROM (SELECT conv_id, turn, strip_accents(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS f FROM conversations)""",
}
ORACLES["number_conflicts"] = f"""WITH n AS (SELECT doc_id, list_filter(string_split(numbers, ' '), lambda x: x <> '') AS n FROM ({ORACLES["number_sets"]}))
  SELECT a.doc_id, len(list_filter(a.n, lambda x: NOT list_contains(b.n, x))) > 0 AS conflict FROM n a JOIN n b ON a.doc_id = b.doc_id + 1"""
