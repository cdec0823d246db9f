"""Secret scans: named patterns, and Markov models of random strings against ordinary identifiers. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.slicing import evaluated_once

#: The kinds in their order, each with its pattern, the group that is measured and its least length.
KINDS = ("assign", "access", "hex", "random")
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: The same spans of access and hex, found without looking at shorter matches: both patterns take whole runs.
LONG = {"access": r"AKIA[A-Z0-9]{14,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+"}

#: Identifiers are runs of letters, digits and these signs, then up to two =; symbol 0 stands for every letter or digit not listed.
RUN = r"[\p{L}\p{N}+/_-]"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SIZE = len(SYMBOLS) + 1
#: Identifiers from this length on are judged; a random one is at least LIMIT more likely, in thousandths of a nat, and by EACH a symbol.
SHORTEST, LIMIT, EACH = 16, 12_000, 750
CANDIDATE = rf"(?<!{RUN}){RUN}{{{SHORTEST},}}+={{0,2}}"
#: Identifiers seen so often in the corpus, and not matched by a named pattern, are ordinary samples.
SEEN = 5
#: Random samples drawn for each alphabet, from a counter's digest.
DRAWN = 4096
#: Added to every count of two symbols.
PRIOR = 0.5
BLOCK = 64


def once(value: Column, then) -> Column:
    """then(value), with value evaluated once: inside a lambda a column's expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _prefix(values: Column, count: Column) -> Column:
    return _total(F.slice(values, F.lit(1), count))


def running_totals(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the sums of the first 1, 2, ... numbers in place of each array, by sums of blocks, far below quadratic work."""
    starts = lambda v: F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    block_sums = lambda v: F.transform(starts(v), lambda b: _total(F.slice(v, b * BLOCK + 1, BLOCK)))
    before = lambda v: F.transform(v, lambda x, b: _prefix(v, b))
    within = lambda v, before: F.transform(v, lambda x, i: F.get(before, (i / BLOCK).cast("int")) + _total(F.slice(v, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)))
    df = evaluated_once(df, **{f"_sums_{n}": block_sums(F.col(n)) for n in names})
    df = evaluated_once(df, **{f"_before_{n}": before(F.col(f"_sums_{n}")) for n in names})
    out = evaluated_once(df, **{f"_totals_{n}": within(F.col(n), F.col(f"_before_{n}")) for n in names})
    return out.drop(*names, *(f"_{k}_{n}" for k in ("sums", "before") for n in names)).withColumnsRenamed({f"_totals_{n}": n for n in names})


def placed(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df with an array of start, end (code points, end exclusive) and found for each pattern's leftmost matches that do not overlap."""
    t, none = F.col(text), F.array().cast("array<string>")
    any_ = {k: F.rlike(t, F.lit(p)) for k, p in patterns.items()}
    df = evaluated_once(df, **{f"_any_{k}": c for k, c in any_.items()})
    found = {f"_found_{k}": F.when(F.col(f"_any_{k}"), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()}
    between = {f"_between_{k}": F.when(F.col(f"_any_{k}"), F.split(t, p, -1)).otherwise(none) for k, p in patterns.items()}
    df = evaluated_once(df, **found, **between)
    steps = lambda k: F.zip_with(F.slice(f"_between_{k}", F.lit(1), F.size(f"_found_{k}")), f"_found_{k}", lambda a, b: (F.length(a) + F.length(b)).cast("bigint"))
    df = running_totals(evaluated_once(df, **{f"_end_{k}": steps(k) for k in patterns}), [f"_end_{k}" for k in patterns])
    spans = lambda k: F.zip_with(f"_end_{k}", f"_found_{k}", lambda end, f: F.struct((end - F.length(f)).alias("start"), end.alias("end"), f.alias("found")))
    return evaluated_once(df, **{k: spans(k) for k in patterns}).drop(*(f"_{x}_{k}" for x in ("any", "found", "between", "end") for k in patterns))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def with_base_spans(df: DataFrame) -> DataFrame:
    """df with the spans (start, kind, end) of each named pattern; matches that are too short are dropped after matching."""
    pattern, group, least = BASE["assign"]
    df = placed(df, "text", {"assign": pattern, **LONG})
    value = F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
    df = evaluated_once(df, _value=value)
    sized = F.zip_with("assign", "_value", lambda s, v: F.when(F.length(v) >= least, s))
    df = df.withColumn("assign", F.filter(sized, lambda s: s.isNotNull())).drop("_value")
    spans = evaluated_once(df.withColumnsRenamed({k: f"_{k}" for k in BASE}), **{k: _spans(F.col(f"_{k}"), k) for k in BASE})
    return spans.drop(*(f"_{k}" for k in BASE))


def symbols(token: Column) -> Column:
    """The numbers of a token's symbols, after the number of its beginning."""
    return F.concat(F.array(F.lit(SIZE)), F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(SYMBOLS), c)))


def cells(token: Column) -> Column:
    """The numbers of a token's pairs of neighbouring symbols."""
    pairs = lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: a * SIZE + b)
    return once(symbols(token), pairs)


def corpus_samples(docs: DataFrame) -> DataFrame:
    """token, label: the different identifiers of all texts, labelled by the named patterns; ordinary ones were seen SEEN times or more.

    An ordinary one also stands for its forms in code: upper case, joined by each sign, camel case, with a number behind.
    """
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(RUN + "{3,}+={0,2}"), F.lit(0))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    label = F.when(F.rlike("token", F.lit(LONG["access"])), "upper").when(F.rlike("token", F.lit(LONG["hex"])), "hex").when(F.col("n") >= SEEN, "ordinary")
    labelled = words.withColumn("label", label).where("label is not null")
    t = F.col("token")
    large = F.translate(t, SYMBOLS[:26], SYMBOLS[26:52])
    number = F.conv(F.substring(F.md5(t.cast("binary")), 1, 3), 16, 10)
    forms = [t, large, F.concat(t, F.substring(large, 1, 1), F.substring(t, F.lit(2), F.length(t))), *(F.concat(t, F.lit(sign), t) for sign in "_-/"), F.concat(large, F.lit("_"), large), F.concat(t, F.lit("_"), number), F.concat(t, number), F.concat(number, F.lit("-"), number)]
    return labelled.select(F.explode(F.when(F.col("label") == "ordinary", F.array(*forms)).otherwise(F.array(t))).alias("token"), "label")


def drawn_samples(spark: SparkSession, count: int = DRAWN) -> DataFrame:
    """token, label: random strings of 16 digits a symbol can take, of capitals and digits, and of the 64 signs of both usual encodings."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256)
    mixed = F.base64(F.unhex(digest))
    capitals = F.concat(*(F.substring(F.lpad(F.conv(F.substring(digest, at, 10), 16, 36), 8, "0"), 2, 7) for at in range(1, 61, 10)))
    drawn = F.create_map(F.lit("hex"), F.array(digest), F.lit("upper"), F.array(capitals), F.lit("mixed"), F.array(mixed, F.translate(mixed, "+/", "-_")))
    return spark.range(count).select(F.explode(drawn).alias("label", "tokens")).select(F.explode("tokens").alias("token"), "label")


def trained(samples: DataFrame) -> DataFrame:
    """One row: label, scores of each random label against the ordinary one, in thousandths of a nat by (symbol before, symbol).

    samples: token, label. Counts of neighbouring symbols add up map-side; what is gathered is one cell per pair of symbols.
    """
    pairs = samples.select("label", F.explode(cells(F.col("token"))).alias("cell"))
    counts = pairs.groupBy("cell").pivot("label", ["ordinary", "hex", "upper", "mixed"]).agg(F.count(F.lit(1)))
    grid = samples.sparkSession.range((SIZE + 1) * SIZE).select(F.col("id").cast("int").alias("cell"))
    full = grid.join(counts, "cell", "left").na.fill(0)
    sums = full.groupBy(F.expr(f"cell div {SIZE}").alias("before")).agg(*(F.sum(c).alias(f"sum_{c}") for c in ("ordinary", "hex", "upper", "mixed")))
    chance = lambda c: (F.col(c) + PRIOR) / (F.col(f"sum_{c}") + PRIOR * SIZE)
    scored = full.withColumn("before", F.expr(f"cell div {SIZE}")).join(sums, "before").select("cell", *(F.round(1000 * F.ln(chance(c) / chance("ordinary"))).cast("bigint").alias(c) for c in ("hex", "upper", "mixed")))
    rows = F.sort_array(F.collect_list(F.struct("cell", "hex", "upper", "mixed")))
    return scored.agg(rows.alias("r")).select(F.struct(*(F.col(f"r.{c}").alias(c) for c in ("hex", "upper", "mixed"))).alias("model"))


def likelihood_ratio(token: Column, model: Column) -> Column:
    """The greatest of the token's log-likelihood ratios, in thousandths of a nat."""
    summed = lambda at, scores: F.aggregate(at, F.lit(0).cast("bigint"), lambda a, c: a + F.get(scores, c))
    return once(cells(token), lambda at: F.greatest(*(summed(at, model[m]) for m in ("hex", "upper", "mixed"))))


def random_spans(candidates: Column, model: Column, assigned: Column) -> Column:
    """Spans of the candidates that a random model explains better, outside of the named patterns' spans."""
    named = "|".join(f"(?:{LONG[k]})" for k in LONG)
    fresh = F.filter(candidates, lambda s: ~F.rlike(s["found"], F.lit(named)))
    judged = F.filter(fresh, lambda s: likelihood_ratio(s["found"], model) >= F.greatest(F.lit(LIMIT), EACH * F.length(s["found"])))
    return F.filter(_spans(judged, "random"), lambda s: ~F.exists(assigned, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def secret_spans(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """docs with assign, access, hex, random: arrays of (start, kind, end) in code points of the column `text`, ends exclusive.

    The first three are the named patterns' matches; `random` are further identifiers of SHORTEST characters or more that
    Markov models of random strings explain better than one of ordinary identifiers (samples: token, label; by default
    those of the corpus and drawn ones). A null text is empty and has no spans; rows are judged each on its own, whatever
    their doc_id; an empty table gives no row. The columns of docs stay, but for any of these four names.
    """
    source = docs.drop(*KINDS).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    if samples is None:
        samples = corpus_samples(source.select("text")).unionByName(drawn_samples(docs.sparkSession))
    found = placed(with_base_spans(source), "text", {"_candidate": CANDIDATE}).withColumn("_model", trained(samples).scalar())
    return evaluated_once(found, random=random_spans(F.col("_candidate"), F.col("_model"), F.col("assign"))).drop("_model", "_candidate")


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans of each kind, the digest of the base spans, and all spans."""
    found = secret_spans(docs.select("doc_id", "text"))
    base = reduce(F.concat, [F.col(k) for k in BASE])
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.concat(base, F.col("random"))).alias("spans"))


def _placed_sql(kind: str, pattern: str, group: int, least: str) -> str:
    """CTE text: r, start, past, found of one pattern's matches; each ends where the texts between and the matches so far end."""
    p = pattern.replace("'", "''")
    so_far = lambda xs: f"list_sum(list_transform({xs}[1:i], lambda x: length(x)))"
    return f"""{kind}_m AS (SELECT r, regexp_extract_all(text, '{p}') AS f, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS s FROM d WHERE regexp_matches(text, '{p}')),
{kind}_i AS (SELECT r, f, v, s, unnest(range(1, len(f) + 1)) AS i FROM {kind}_m),
{kind}_s AS (SELECT r, CAST({so_far('s')} + {so_far('f')} - length(f[i]) AS BIGINT) AS start, CAST({so_far('s')} + {so_far('f')} AS BIGINT) AS past, f[i] AS found FROM {kind}_i WHERE length({least}) >= {BASE[kind][2] if kind in BASE else SHORTEST})"""


def _cells_sql(token: str) -> str:
    codes = f"list_transform(range(1, length({token}) + 1), lambda j: instr('{SYMBOLS}', substr({token}, j, 1)))"
    return f"list_transform(list_zip(list_prepend({SIZE}, {codes}), {codes})[1:length({token})], lambda z: z[1] * {SIZE} + z[2])"


#: The same rows: the patterns' matches by Perl-like expressions, and the models' counts and scores as tables.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_placed_sql('assign', BASE['assign'][0], 2, 'v[i]')},
{_placed_sql('access', BASE['access'][0], 0, 'f[i]')},
{_placed_sql('hex', BASE['hex'][0], 0, 'f[i]')},
{_placed_sql('random', RUN + '+={0,2}', 0, "rtrim(f[i], '=')")},
base AS (SELECT r, 'assign' AS kind, 0 AS no, start, past FROM assign_s UNION ALL SELECT r, 'access', 1, start, past FROM access_s UNION ALL SELECT r, 'hex', 2, start, past FROM hex_s),
seen AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{RUN}{{3,}}={{0,2}}')) AS token FROM d) GROUP BY 1),
labelled AS (SELECT token, CASE WHEN regexp_matches(token, 'AKIA[A-Z0-9]{{14,}}') THEN 'upper' WHEN regexp_matches(token, '[0-9a-f]{{16,}}') THEN 'hex' WHEN n >= {SEEN} THEN 'ordinary' END AS label,
  translate(token, '{SYMBOLS[:26]}', '{SYMBOLS[26:52]}') AS large, CAST(CAST('0x' || substr(md5(token), 1, 3) AS INTEGER) AS VARCHAR) AS num FROM seen),
drawn AS (SELECT sha256('sample ' || i) AS h FROM range({DRAWN}) t(i)),
tokens AS (
  SELECT label, unnest(CASE WHEN label = 'ordinary' THEN [token, large, token || substr(large, 1, 1) || substr(token, 2), token || '_' || token, token || '-' || token, token || '/' || token, large || '_' || large, token || '_' || num, token || num, num || '-' || num] ELSE [token] END) AS token FROM labelled WHERE label IS NOT NULL
  UNION ALL SELECT 'hex', h FROM drawn
  UNION ALL SELECT 'mixed', unnest([to_base64(unhex(h)), translate(to_base64(unhex(h)), '+/', '-_')]) FROM drawn
  UNION ALL SELECT 'upper', array_to_string(list_transform(range(1, 61, 10), lambda a: array_to_string(list_transform(range(6, -1, -1), lambda e: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((CAST('0x' || substr(h, a, 10) AS BIGINT) // CAST(pow(36, e) AS BIGINT)) % 36 + 1 AS INTEGER), 1)), '')), '') FROM drawn),
pairs AS (SELECT label, cell, count(*) AS c FROM (SELECT label, unnest({_cells_sql('token')}) AS cell FROM tokens) GROUP BY 1, 2),
grid AS (SELECT i AS cell, g.label, coalesce(c, 0) AS c FROM (SELECT i, label FROM range({(SIZE + 1) * SIZE}) t(i), (VALUES ('ordinary'), ('hex'), ('upper'), ('mixed')) l(label)) g LEFT JOIN pairs ON pairs.cell = i AND pairs.label = g.label),
chances AS (SELECT cell, label, (c + {PRIOR}::DOUBLE) / (sum(c) OVER (PARTITION BY label, cell // {SIZE}) + {PRIOR}::DOUBLE * {SIZE}) AS p FROM grid),
scores AS (SELECT a.cell, a.label, CAST(round(1000 * ln(a.p / o.p)) AS BIGINT) AS score FROM chances a JOIN chances o ON o.cell = a.cell AND o.label = 'ordinary' WHERE a.label <> 'ordinary'),
fresh AS (SELECT row_number() OVER () AS c, r, start, past, found FROM random_s WHERE NOT regexp_matches(found, 'AKIA[A-Z0-9]{{14,}}|[0-9a-f]{{16,}}')),
ratios AS (SELECT c, label, sum(score) AS ratio FROM (SELECT c, unnest({_cells_sql('found')}) AS cell FROM fresh) JOIN scores USING (cell) GROUP BY 1, 2),
extra AS (SELECT r, 'random' AS kind, 3 AS no, start, past FROM fresh f WHERE (SELECT max(ratio) FROM ratios q WHERE q.c = f.c) >= greatest({LIMIT}, {EACH} * length(found))
  AND NOT EXISTS (SELECT 1 FROM assign_s a WHERE a.r = f.r AND a.start < f.past AND f.start < a.past)),
every AS (SELECT *, kind || ':' || start || ':' || past AS w FROM (SELECT * FROM base UNION ALL SELECT * FROM extra)),
lists AS (SELECT r, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
  string_agg(w, ',' ORDER BY start, no) FILTER (WHERE no < 3) AS base, string_agg(w, ',' ORDER BY start, no) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (r)
"""
