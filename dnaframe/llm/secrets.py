"""(4) Secret scans: sliding-window Shannon entropy over candidate strings, built-in functions only.

Named rules (``assign``, ``access``, ``hex``) give the base spans. Beside them, every maximal
run of the base64url alphabet is a candidate: the entropy of each window of ``window``
characters is kept up to date from counts as one character enters and one leaves, measured
against the limit of the candidate's character class, and the stretch from the first to the
last hot window becomes an ``entropy`` span. Allow-listed candidates and those inside a base
span add nothing.

The query and redaction look closer (``closely``): there a window is hot too if its own characters' class and
limit say so, it holds no placeholder, and not all segments (between - _ / +) that it touches are plain:
word-like letters, digits, alphabets in order, UUIDs. So a name or a path around a secret, or a placeholder
elsewhere in the run, hides nothing. Random letters of one case can't be told from words.

Spans count code points, end exclusive. Null and empty texts have no spans. Rows are scanned on
their own: repeated rows give repeated results, and an empty table an empty one. Only the text
column is read; other columns pass through, so the added column is the caller's to name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnaframe.llm.common import let

# The contract's patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]
#: A failing access or hex match leaves nothing inside itself that could match, so its length may
#: stand in the pattern. An assignment may: there the whole match is taken first, then judged.
ACCESS_LONG, HEX_LONG, ASSIGN_VALUE = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", 6

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
WINDOW = 20
#: Bits per character that the hottest window must reach, by class: (name, pattern, limit).
#: Digits only, and words of letters only, never count as secrets by their entropy alone.
CLASSES = [("hex", r"^[0-9A-Fa-f]*$", 3.05), ("upper", r"^[A-Z0-9]*$", 3.55), ("mixed", r"", 3.75)]
#: Candidates that look random and are not: all letters or all digits, words joined by - _ /,
#: UUIDs, alphabets in order, placeholders.
ALLOW = [r"^[A-Za-z]+$", r"^[0-9]+$", r"^[A-Za-z]+([-_/+][A-Za-z]+)+$",
         r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
         r"(?i)(0123456789|abcdefghij|qwertyuiop)", r"(?i)(example|sample|placeholder|changeme|redacted|x{8,}|your[-_])"]

#: Looking closely: what makes a segment plain, what a window must not hold, and what is plain as a whole.
PLAIN = [r"^([A-Z]?[a-z]+([A-Z][a-z]{2,})*|[A-Z]+)$", r"^[0-9]+$", ALLOW[4]]
PLACEHOLDER = ALLOW[5]
UUID = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])"

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _located(text: Column, pattern: str) -> Column:
    """array<struct(start, end, match)> of the leftmost non-overlapping matches, linear in their number.

    Starts are running sums of the lengths of matches and of the text between them; they are
    summed in blocks so that a text with very many matches stays cheap.
    """
    block = 256
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(s: Column) -> Column:
        both = F.arrays_zip(s["gaps"].alias("gap"), s["found"].alias("match"))
        both = F.filter(both, lambda x: x["match"].isNotNull())
        return let(both, lambda z: let(
            F.transform(z, lambda x: F.struct(F.length(x["gap"]).alias("g"), F.length(x["match"]).alias("m"))),
            lambda lens: let(
                F.transform(F.sequence(F.lit(0), F.ceil(F.size(lens) / F.lit(block)).cast("int")), lambda b: F.aggregate(
                    F.slice(lens, b * block + 1, F.lit(block)), F.lit(0).cast("long"), lambda a, x: a + x["g"] + x["m"])),
                lambda sums: let(
                    F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0).cast("long"),
                                                               lambda a, x: a + x)),
                    lambda base: F.transform(z, lambda x, i: let(
                        F.element_at(base, (i / block).cast("int") + 1) + F.aggregate(
                            F.slice(lens, (i / block).cast("int") * block + 1, i % block), F.lit(0).cast("long"),
                            lambda a, y: a + y["g"] + y["m"]) + F.length(x["gap"]),
                        lambda start: F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"),
                                               x["match"].alias("match"))))))))

    return let(F.struct(text.alias("text"), found.alias("found")), lambda s: F.when(
        F.size(s["found"]) > 0,
        let(F.struct(F.split(s["text"], pattern, -1).alias("gaps"), s["found"].alias("found")), place)
    ).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")))


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
                    F.lit(kind).alias("kind"))


def _plain(match: Column) -> Column:
    """``match`` with the characters of its plain segments and all separators replaced by dots, the others by x."""
    parts = F.split(F.regexp_replace(match, UUID, "-" * 36), r"(?<=[-_/+])|(?=[-_/+])")

    def mark(p: Column) -> Column:
        plain = p.rlike(r"^[-_/+]$")
        for pattern in PLAIN:
            plain = plain | p.rlike(pattern)
        return F.repeat(F.when(plain, ".").otherwise("x"), F.length(p))

    return F.array_join(F.transform(parts, mark), "")


def _hot(match: Column, limit: Column, window: int, close=None) -> Column:
    """struct(first, last): starts of the first and last window of at least ``limit`` bits, null if none.

    ``close(start, bits)``: whether the window there is hot whatever the limit.

    The state holds one count per character and the sum of n log n over them; a step adds the
    entering character and takes the leaving one away.
    """
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    code = lambda c: F.instr(F.lit(ALPHABET), c)

    def is_hot(i: Column, bits: Column) -> Column:
        hot = F.coalesce(bits >= limit, F.lit(False))
        return (i >= window) & (hot if close is None else hot | close(i - window, bits))

    def step(s: Column, i: Column) -> Column:
        entering = code(F.substring(match, i, F.lit(1)))
        leaving = F.when(i > window, code(F.substring(match, i - window, F.lit(1)))).otherwise(F.lit(0))
        return let(F.struct(entering.alias("x"), leaving.alias("y")), lambda m: let(
            F.transform(s["n"], lambda v, k: v - F.when(k + 1 == m["y"], 1).otherwise(0)), lambda left: let(
                s["sum"] + F.when(m["y"] > 0, F.element_at(weight, F.element_at(left, F.greatest(m["y"], F.lit(1))) + 1)
                                  - F.element_at(weight, F.element_at(left, F.greatest(m["y"], F.lit(1))) + 2)).otherwise(0.0)
                + F.element_at(weight, F.element_at(left, m["x"]) + 2) - F.element_at(weight, F.element_at(left, m["x"]) + 1),
                lambda total: let(is_hot(i, F.lit(math.log2(window)) - total / window), lambda hot: F.struct(
                    F.transform(left, lambda v, k: v + F.when(k + 1 == m["x"], 1).otherwise(0)).alias("n"),
                    total.alias("sum"),
                    F.when(hot, F.coalesce(s["first"], i - window)).otherwise(s["first"]).alias("first"),
                    F.when(hot, i - window).otherwise(s["last"]).alias("last"))))))

    start = F.struct(F.array(*[F.lit(0)] * len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"),
                     F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(match)), start, step,
                       lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secret_spans", window: int = WINDOW,
                 classes: list[tuple[str, str, float]] | None = None, allow: list[str] | None = None,
                 closely: bool = False) -> DataFrame:
    """``docs`` with ``out``: array<struct<start, rank, end, kind>>, sorted by start, then kind as in ``KINDS``.

    ``classes``: (name, pattern, least entropy in bits), the first pattern that fits a candidate
    decides. ``allow``: patterns of candidates to leave alone. ``closely``: windows are judged on their own as well.
    """
    classes, allow = classes or CLASSES, ALLOW if allow is None else allow
    assign = F.transform(
        F.filter(_located(F.col(text), ASSIGN),
                 lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_VALUE),
        lambda x: _span(x["start"], x["end"], "assign"))
    access = F.transform(_located(F.col(text), ACCESS_LONG), lambda x: _span(x["start"], x["end"], "access"))
    hexes = F.transform(_located(F.col(text), HEX_LONG), lambda x: _span(x["start"], x["end"], "hex"))

    def limit(match: Column) -> Column:
        case = None
        for _, pattern, bits in classes:
            case = F.when(match.rlike(pattern), bits) if case is None else case.when(match.rlike(pattern), bits)
        return case.otherwise(F.lit(None).cast("double"))

    def added(base: Column) -> Column:
        def outside(x: Column) -> Column:
            return ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))

        def fresh(match: Column) -> Column:
            keep = F.lit(True)
            for pattern in allow:
                keep = keep & ~match.rlike(pattern)
            return keep

        def measured(match: Column) -> Column:
            if not closely:
                return _hot(match, limit(match), window)

            def close(plain: Column):
                def judged(w: Column, start: Column, bits: Column) -> Column:
                    return (F.coalesce(bits >= limit(w), F.lit(False)) & ~w.rlike(PLACEHOLDER)
                            & F.substring(plain, start + 1, F.lit(window)).contains("x"))

                return lambda start, bits: F.when(bits >= min(c[2] for c in classes), let(
                    F.substring(match, start + 1, F.lit(window)), lambda w: judged(w, start, bits))).otherwise(False)

            # no limit for a run that the allow-list names: only its windows count
            return let(F.struct(_plain(match).alias("plain"), F.when(fresh(match), limit(match)).alias("limit")),
                       lambda m: _hot(match, m["limit"], window, close(m["plain"])))

        keep = outside if closely else lambda x: outside(x) & fresh(x["match"])
        hot = F.transform(F.filter(_located(F.col(text), CANDIDATE), keep), lambda x: F.struct(
            x["start"].alias("start"), measured(x["match"]).alias("hot")))
        return F.transform(F.filter(hot, lambda x: x["hot"]["first"].isNotNull()), lambda x: _span(
            x["start"] + x["hot"]["first"], x["start"] + x["hot"]["last"] + window, "entropy"))

    spans = let(F.concat(assign, access, hexes), lambda base: F.array_sort(F.concat(base, added(base))))
    none = F.array().cast(f"array<{SPAN}>")
    return docs.withColumn(out, F.when(F.col(text).isNull(), none).otherwise(spans).cast(f"array<{SPAN}>"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` in the same columns, its texts without their secrets and ``n_chars``, if there, counted anew."""
    found = find_secrets(docs.select(F.struct("*").alias("doc"), "text"), out="spans", closely=True)
    doc = F.col("doc").withField("text", redact("text", "spans"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(F.size("spans") > 0, F.length(redact("text", "spans")))
                            .otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(doc.alias("doc")).select("doc.*")


def redact(text: str = "text", spans: str = "secret_spans", mark: str = "<secret>") -> Column:
    """The text with every stretch covered by spans replaced by ``mark`` (touching spans: one mark)."""
    source, found = F.col(text), F.col(spans)

    def join(s: Column, x: Column) -> Column:
        return F.struct(
            F.when(x["start"] < s["end"], s["out"]).otherwise(F.concat(
                s["out"], F.substring(source, (s["end"] + 1).cast("int"), (x["start"] - s["end"]).cast("int")),
                F.lit(mark))).alias("out"),
            F.greatest(s["end"], x["end"]).alias("end"))

    done = F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("end")), join,
                       lambda s: F.concat(s["out"], F.substring(source, (s["end"] + 1).cast("int"), F.length(source))))
    return F.when(F.size(found) > 0, done).otherwise(source)


def digest(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of the spans of ``kinds``, comma-joined in their order."""
    return F.concat_ws(",", F.transform(F.filter(spans, lambda x: x["kind"].isin(kinds)), lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def secrets_query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    s = F.col("spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    found = find_secrets(docs.select("doc_id", "text"), out="spans", closely=True)
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(digest(s, KINDS[:3]), 256).alias("base_sha256"), digest(s, KINDS).alias("spans"))


_D_AT = """list_transform(range(1, len({m}) + 1), lambda i: {{
  'start': coalesce(list_sum([length(x) for x in {g}[1:i]]), 0) + coalesce(list_sum([length(x) for x in {m}[1:i - 1]]), 0),
  'match': {m}[i]}})"""

SQL_ALLOW = " OR ".join(f"regexp_matches(c.match, '{p}')" for p in ALLOW)

SQL_PLAIN = " OR ".join(f"regexp_matches(p, '{x}')" for x in ["^[-_/+]$", *PLAIN])
# no look-around there: what borders a UUID is matched and put back, twice for neighbours that share it
SQL_UUID = r"(^|[^0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}($|[^0-9A-Za-z])"
SQL_GONE = r"\1" + "-" * 36 + r"\2"


def _sql_limit(word: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({word}, '{p}') THEN {bits}" for _, p, bits in CLASSES) + " END"


#: DuckDB's version: positions from the text between matches, window entropies counted anew.
ORACLE_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), a AS (
  SELECT row, doc_id, text,
    regexp_extract_all(text, '{ASSIGN.replace("'", "''")}') AS am,
    string_split_regex(text, '{ASSIGN.replace("'", "''")}') AS ag,
    regexp_extract_all(text, '{ACCESS}') AS cm, string_split_regex(text, '{ACCESS}') AS cg,
    regexp_extract_all(text, '{HEX_LONG}') AS hm, string_split_regex(text, '{HEX_LONG}') AS hg,
    regexp_extract_all(text, '{CANDIDATE}') AS em, string_split_regex(text, '{CANDIDATE}') AS eg
  FROM t
), b AS (
  SELECT row, doc_id, {_D_AT.format(m='am', g='ag')} AS al, {_D_AT.format(m='cm', g='cg')} AS cl,
    {_D_AT.format(m='hm', g='hg')} AS hl, {_D_AT.format(m='em', g='eg')} AS el FROM a
), base AS (
  SELECT row, 'assign' AS kind, 0 AS rank, x.start AS s, x.start + length(x.match) AS e
  FROM (SELECT row, unnest(al) AS x FROM b)
  WHERE length(regexp_extract(x.match, '{ASSIGN.replace("'", "''")}', 2)) >= {ASSIGN_VALUE}
  UNION ALL
  SELECT row, 'access', 1, x.start, x.start + length(x.match) FROM (SELECT row, unnest(cl) AS x FROM b)
  WHERE length(x.match) >= 20
  UNION ALL
  SELECT row, 'hex', 2, x.start, x.start + length(x.match) FROM (SELECT row, unnest(hl) AS x FROM b)
), cand AS (
  SELECT u.row, c, NOT ({SQL_ALLOW}) AS fresh, regexp_replace(regexp_replace(c.match, '{SQL_UUID}', '{SQL_GONE}', 'g'), '{SQL_UUID}', '{SQL_GONE}', 'g') AS bare
  FROM (SELECT row, unnest(el) AS c FROM b) AS u
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.row = u.row AND base.s <= c.start AND c.start + length(c.match) <= base.e)
), judged AS (
  SELECT row, c.start AS pos, c.match AS m, CASE WHEN fresh THEN {_sql_limit('c.match')} END AS bits,
    array_to_string([CASE WHEN {SQL_PLAIN} THEN repeat('.', length(p)) ELSE repeat('x', length(p)) END
                     FOR p IN regexp_extract_all(bare, '[-_/+]|[^-_/+]+')], '') AS plain
  FROM cand
), windows AS (
  SELECT row, pos, bits, [{{'w': substr(m, i, {WINDOW}), 'x': contains(substr(plain, i, {WINDOW}), 'x'), 'i': i}}
                          FOR i IN range(1, length(m) - {WINDOW} + 2)] AS ws FROM judged
), hot AS (
  SELECT row, pos, [v.i FOR v IN ws IF coalesce(list_aggregate(string_split(v.w, ''), 'entropy') >= bits, false)
    OR (v.x AND NOT regexp_matches(v.w, '{PLACEHOLDER}') AND list_aggregate(string_split(v.w, ''), 'entropy') >= {_sql_limit('v.w')})] AS w FROM windows
), every_span AS (
  SELECT * FROM base
  UNION ALL
  SELECT row, 'entropy', 3, pos + w[1] - 1, pos + w[-1] - 1 + {WINDOW} FROM hot WHERE len(w) > 0
), one AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM every_span GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN one USING (row)
"""
