"""Personal data: regular expressions propose spans, checksums confirm them, context moves their score.

Everything here is a DataFrame expression; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The proposals. They match what the plain patterns match: a match begins where its run of characters
# begins or where the last match ended (\G), and possessive repeats give nothing back. That keeps the
# work linear on long runs and Java's stack flat.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _iban_tries() -> str:
    """A place where an IBAN may begin, without its characters: group 1 is the text cut to its country's
    length, group 2 the longest text that PATTERNS proposes. A group that does not match is empty."""
    by_length = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    cut = "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    longest = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?=({cut})(?![A-Za-z0-9])))?(?:(?=({longest})(?![A-Za-z0-9])))?"


IBAN_TRIES = _iban_tries()
BASE = ("email", "ip", "card", "phone")
# Gates that are cheap to miss; a text that fails one has no match of the kind.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
}
CONTEXT = {
    "email": "e-?mail|mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|mastercard",
    "phone": "phone|call|tel|telephone|mobile|fax",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
}
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT_CHARS = 40

SPAN = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>"
CHUNK = 64  # matches whose places are added up one after the other


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (F.lit(1) + F.pmod(i, F.lit(2)))
        return d - F.when(d > 9, 9).otherwise(0)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, x: a + x), F.lit(10)) == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes its mod-97 check."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        v = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(v < 65, F.pmod(acc * 10 + v - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + v - 55, F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "card":
        return F.when(F.length(_digits(text)).between(13, 19), luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(array: Column) -> Column:
    """An array that is not empty as an array of arrays of CHUNK elements."""
    return F.transform(F.sequence(F.lit(0), F.size(array) - 1, F.lit(CHUNK)), lambda i: F.slice(array, i + 1, F.lit(CHUNK)))


def _by_chunks(array: Column, first: Column, after, spans) -> Column:
    """flatten of spans(chunk, state) over an array's chunks, where after(state, chunk) is the state after a
    chunk and `first` the one before all. Appending to an array copies it, so one fold over all matches
    would take the square of their number; states are a CHUNK-th of them."""

    def fold(chunks: Column) -> Column:
        states = F.aggregate(chunks, F.array(first), lambda acc, c: F.concat(acc, F.array(after(F.element_at(acc, -1), c))))
        return F.flatten(F.zip_with(chunks, F.slice(states, 1, F.size(chunks)), spans))

    return let(array, lambda a: let(_chunks(a), fold))


def score(kind: str, before: Column, after: Column) -> Column:
    """From 0 to 1: the kind's own, raised by a context word within CONTEXT_CHARS of the text between this
    match and its neighbours."""
    near = F.concat(F.right(before, F.lit(CONTEXT_CHARS)), F.lit("\n"), F.left(after, F.lit(CONTEXT_CHARS)))
    base = START_SCORE[kind]
    return F.when(near.rlike(f"(?i)(?:^|[^A-Za-z0-9])(?:{CONTEXT[kind]})(?:[^A-Za-z0-9]|$)"), F.lit(round((1 + base) / 2, 3))).otherwise(F.lit(base))


def _span(kind: str, start: Column, end: Column, text: Column, value: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), text.alias("text"), value.alias("score"))).cast(SPAN)


def find_kind(text: Column, kind: str) -> Column:
    """Spans of one kind in order, with scores. Matches and the gaps between them give the positions."""
    pattern = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = let(F.split(text, pattern, -1), lambda g: F.arrays_zip(g.alias("gap"), hits.alias("hit"), F.slice(g, F.lit(2), F.size(g)).alias("next")))
    width = lambda p: F.length(p["gap"]).cast("long") + F.coalesce(F.length(p["hit"]).cast("long"), F.lit(0).cast("long"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + width(p)
        one = _span(kind, acc["at"] + F.length(p["gap"]).cast("long"), end, p["hit"], score(kind, p["gap"], p["next"]))
        keep = F.when(p["hit"].isNotNull(), _valid(kind, p["hit"])).otherwise(False)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = _by_chunks(
        pieces, F.lit(0).cast("long"),
        lambda at, c: F.aggregate(c, at, lambda a, p: a + width(p)),
        lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast(SPAN).alias("found")), step)["found"],
    )
    return F.when(GATES[kind](text), found).otherwise(F.array().cast(SPAN))


def find_ibans(text: Column) -> Column:
    """Spans of IBANs in order, with scores. Each place where one may begin is tried by itself, so a text
    that fails its checksum hides none that begins inside it: first cut to its country's length, so that a
    word after it is left alone, then as long as PATTERNS proposes. Of overlapping spans the first stays."""
    line = F.concat(F.lit("\n"), text)  # split() drops the empty piece before an empty match at the start
    tries = [F.regexp_extract_all(line, F.lit(IBAN_TRIES), F.lit(i)) for i in (1, 2)]
    pieces = let(F.split(line, IBAN_TRIES, -1), lambda g: F.arrays_zip(g.alias("gap"), tries[0].alias("cut"), tries[1].alias("longest"), F.slice(g, F.lit(2), F.size(g)).alias("next")))
    passes = lambda c: F.when(F.length(c) > 0, mod97(c)).otherwise(False)

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["gap"]).cast("long")
        hit = F.when(passes(p["cut"]), p["cut"]).when(passes(p["longest"]), p["longest"])
        one = lambda h: _span("iban", at, at + F.length(h).cast("long"), h, score("iban", p["gap"], F.substring(p["next"], F.length(h) + 1, F.lit(CONTEXT_CHARS))))
        return F.struct(at.alias("at"), let(hit, lambda h: F.when(h.isNotNull(), F.concat(acc["found"], one(h))).otherwise(acc["found"])).alias("found"))

    found = _by_chunks(
        pieces, F.lit(-1).cast("long"),
        lambda at, c: F.aggregate(c, at, lambda a, p: a + F.length(p["gap"]).cast("long")),
        lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast(SPAN).alias("found")), step)["found"],
    )
    end = lambda acc: F.when(F.size(acc) > 0, F.element_at(acc, -1)["end"]).otherwise(0)
    apart = F.aggregate(found, F.array().cast(SPAN), lambda acc, s: F.when(s["start"] >= end(acc), F.concat(acc, F.array(s))).otherwise(acc))
    return F.when(GATES["iban"](text), apart).otherwise(F.array().cast(SPAN))


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds column `out`: the spans of every kind, ordered by kind as in PATTERNS and then by start,
    each with kind, start, end (code points, end exclusive), text and score. A null or empty text has none,
    a text of any length is searched whole in time close to its length, whatever it holds. Other columns,
    of any name, rows and their number stay as they are; only a column of the name `out` is replaced."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != out)).alias("row")
    found = df.select(row, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    spans = F.concat(*(find_ibans(F.col("t")) if k == "iban" else find_kind(F.col("t"), k) for k in PATTERNS))
    return found.select("row", spans.alias("spans")).select("row.*", F.col("spans").alias(out))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the
    first names the whole stretch."""
    ends = lambda at, c: F.aggregate(c, at, lambda a, s: F.greatest(a, s["end"]))

    def part(c: Column, at: Column) -> Column:
        """What the chunk's spans leave of the text from the end of those before."""

        def step(acc: Column, s: Column, piece: Column) -> Column:
            gap = F.substring(piece, (acc["at"] - at + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
            new = F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

        zero = F.struct(at.alias("at"), F.lit("").alias("out"))
        piece = F.substring(text, (at + 1).cast("int"), (ends(at, c) - at).cast("int"))
        return F.array(let(piece, lambda x: F.aggregate(c, zero, lambda acc, s: step(acc, s, x))["out"]))

    zero = F.lit(0).cast("long")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = let(ordered, lambda o: F.concat(F.array_join(_by_chunks(o, zero, ends, part), ""), F.substring(text, (ends(zero, o) + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    scores = F.concat_ws(",", F.transform(base, lambda s: F.format_string("%.2f", s["score"])))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), scores.alias("scores"))


def _sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    }
    digits = "regexp_replace(h, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(0, length({digits})), lambda i: (CAST(substr(reverse({digits}), i + 1, 1) AS INT) * (1 + i % 2)) % 10 + (CAST(substr(reverse({digits}), i + 1, 1) AS INT) * (1 + i % 2)) // 10)) % 10 = 0"
    valid = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(h, '.'), lambda p: CAST(p AS HUGEINT))) <= 255",
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn_sql} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(replace(h, ' ', ''), 5) || substr(replace(h, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c < 'A' THEN CAST(ascii(c) - 48 AS BIGINT) ELSE ascii(c) - 55 END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1",
    }
    parts = []
    for n, (k, p) in enumerate(plain.items()):
        parts.append(f"""
SELECT doc_id, {n} AS o, '{k}' AS kind, s, s + length(h) AS e, h, CASE WHEN regexp_matches(near, '(?i)(^|[^A-Za-z0-9])({CONTEXT[k]})([^A-Za-z0-9]|$)') THEN '{(1 + START_SCORE[k]) / 2:.2f}' ELSE '{START_SCORE[k]:.2f}' END AS score FROM (
  SELECT doc_id, h[i] AS h, right(g[i], {CONTEXT_CHARS}) || chr(10) || left(g[i + 1], {CONTEXT_CHARS}) AS near, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, g, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h FROM d)))
WHERE {valid[k]}""")
    counts = ", ".join(f"coalesce(count(kind) FILTER (kind = '{k}'), 0) AS n_{k}" for k in BASE)
    row = "kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({row}, ',' ORDER BY o, s) FILTER (o < 4), '')) AS base_sha256,
  coalesce(string_agg({row}, ',' ORDER BY o, s), '') AS spans, coalesce(string_agg(score, ',' ORDER BY o, s) FILTER (o < 4), '') AS scores
FROM d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id"""


SQL = _sql()
