"""Personal data in text: patterns propose spans, checksums confirm them, context words adjust a score.

Built-in functions only: the text between and inside the matches gives each span's place, because
`split` and `regexp_extract_all` walk the same matches. All patterns walk a text once, and running totals go by blocks,
so that the time grows with the text's length and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in the order that breaks ties.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_id")
KINDS = BASE_KINDS + ADDED_KINDS

# Possessive quantifiers keep the matcher free of recursion and change no match. An address can begin only where a run of
# its characters begins or where the match before ended: any later start in a run leads to the same '@' or dot. A card is
# a whole run of digits with single separators; runs of another length can't match, so that long tables of numbers
# propose nothing.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
SHAPES = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "national_id": NATIONAL_ID}
#: A text without this can't hold the kind.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{10}", "phone": r"\+[0-9]", "iban": "[A-Z][A-Z][0-9][0-9]", "national_id": "[0-9]-[0-9]"}

#: Whole words near a span that make its kind likelier.
CONTEXT = {
    "email": "e-?mails?|mails?|mailto|contact|write|courriel|correo|schreib|schreiben",
    "ip": "ip|ips|ipv4|hosts?|servers?|address|login",
    "card": "cards?|visa|mastercard|credit|carte|karte|kreditkarte|tarjeta|payment",
    "phone": "tel|telefon|telephone|phones?|call|mobile|fax|anruf|appel",
    "iban": "iban|accounts?|bank|konto|compte|cuenta",
    "national_id": "ssn|social|passport|national|identity|ausweis|dni|insee",
}
#: Score without context; a checksum counts more than a shape. Context adds CONTEXT_GAIN.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.3}
CONTEXT_GAIN, CONTEXT_CHARS, ACCEPT = 0.2, 40, 0.5
#: Elements that a running total or a masked text takes at a time.
BLOCK = 128
WORD_CHAR = r"[\p{L}\p{N}]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True when the digit string passes the Luhn check (every second digit from the right doubled)."""
    at = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(
        at,
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (F.length(digits) - i) % 2 == 1,
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1),
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """True when the IBAN's check digits hold: first four characters moved to the end, letters as 10..35, remainder 1."""
    flat = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often then uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _blocks(values: Column) -> Column:
    """values in arrays of BLOCK elements; one empty block for an empty array."""
    many = lambda v: F.greatest(F.ceil(F.size(v) / BLOCK).cast("int"), F.lit(1))
    return _let(values, lambda v: F.transform(F.sequence(F.lit(0), many(v) - 1), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of ints of 0 or more under an associative combine. Arrays grow within a block only."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    totals = lambda block: F.aggregate(block, _empty("int"), lambda acc, x: F.concat(acc, F.array(combine(last(acc), x))))
    before = lambda inner: F.aggregate(inner, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(combine(last(acc), last(block)))))
    added = lambda block, t: F.transform(F.coalesce(block, _empty("int")), lambda x: combine(x, t))
    return F.flatten(_let(F.transform(_blocks(values), totals), lambda inner: F.zip_with(inner, before(inner), added)))


def _near(x: Column, kind: str) -> Column:
    """Whether a context word of the kind stands, whole, among the CONTEXT_CHARS characters before or after a span."""
    words = f"(?:{CONTEXT[kind]})"
    before = F.right(F.concat(F.lit(" "), x["before"]), F.lit(CONTEXT_CHARS + 1))
    after = F.left(F.concat(x["after"], F.lit(" ")), F.lit(CONTEXT_CHARS + 1))
    return before.rlike(f"(?i)(?<=[^\\p{{L}}\\p{{N}}]){words}(?!{WORD_CHAR})") | after.rlike(f"(?i)(?<!{WORD_CHAR}){words}(?=[^\\p{{L}}\\p{{N}}])")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    return F.lit(True)


def _spans(df: DataFrame) -> DataFrame:
    """df (columns _k0.., and _text without nulls) with _base and _spans, both sorted by start, then kind."""
    own = [c for c in df.columns]
    text, none = F.col("_text"), _empty("string")
    for_kind = {k: F.contains(text, F.lit(g)) if g == "@" else text.rlike(g) for k, g in GATES.items()}
    df = df.select(
        *own,
        *[F.when(for_kind[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"_found_{k}") for k, p in SHAPES.items()],
        *[F.when(for_kind[k], F.split(text, p, -1)).otherwise(none).alias(f"_between_{k}") for k, p in SHAPES.items()],
    )
    steps = {k: F.zip_with(f"_found_{k}", f"_between_{k}", lambda m, b: F.coalesce(F.length(m), F.lit(0)) + F.length(b)) for k in KINDS}
    ends = [F.when(F.size(f"_found_{k}") > 0, _running(steps[k], lambda a, b: a + b)).otherwise(_empty("int")).alias(f"_ends_{k}") for k in KINDS]
    df = df.select("*", *ends)

    def proposed(k: str) -> Column:
        gaps = F.zip_with(f"_between_{k}", F.slice(f"_between_{k}", F.lit(2), F.greatest(F.size(f"_between_{k}") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
        matches = F.zip_with(f"_found_{k}", f"_ends_{k}", lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
        both = F.zip_with(matches, gaps, lambda m, g: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), g["before"].alias("before"), g["after"].alias("after")))
        return F.filter(both, lambda x: x["value"].isNotNull() & _valid(k, x["value"]))

    def scored(k: str) -> Column:
        def one(x: Column) -> Column:
            score = F.lit(PRIOR[k]) + F.when(_near(x, k), CONTEXT_GAIN).otherwise(0.0)
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("ord"), F.lit(k).alias("kind"), x["end"].alias("end"), score.alias("score"))

        span = "struct<start:int,ord:int,kind:string,end:int,score:double>"
        return F.when(F.size(f"_found_{k}") > 0, F.transform(proposed(k), one)).otherwise(_empty(span))

    df = df.select(*own, F.sort_array(F.concat(*map(scored, BASE_KINDS))).alias("_base"), F.filter(F.concat(*map(scored, ADDED_KINDS)), lambda a: a["score"] >= ACCEPT).alias("_more"))
    # An added span goes when a base span overlaps it: one that starts before it and reaches it, or one that starts inside.
    line = F.sort_array(F.concat("_base", "_more"))
    df = df.select(*own, "_base", F.when(F.size("_more") > 0, line).otherwise(F.col("_base")).alias("_line"), (F.size("_more") > 0).alias("_mixed"))
    is_base = lambda x: x["ord"] < len(BASE_KINDS)
    reach = _running(F.transform("_line", lambda x: F.when(is_base(x), x["end"]).otherwise(0)), F.greatest)
    last = F.lit((1 << 31) - 1)
    following = F.transform(_running(F.transform(F.reverse("_line"), lambda x: F.when(is_base(x), last - x["start"]).otherwise(0)), F.greatest), lambda v: last - v)
    df = df.select(*own, "_base", "_line", "_mixed", F.when(F.col("_mixed"), reach).alias("_reach"), F.when(F.col("_mixed"), F.reverse(following)).alias("_following"))
    judged = F.zip_with(F.zip_with("_line", "_reach", lambda x, r: F.struct(x.alias("x"), r.alias("r"))), "_following", lambda y, f: F.struct(y["x"].alias("x"), y["r"].alias("r"), f.alias("f")))
    clear = F.filter(judged, lambda y: is_base(y["x"]) | (y["r"] <= y["x"]["start"]) & (y["f"] >= y["x"]["end"]))
    return df.select(*own, "_base", F.when(F.col("_mixed"), F.transform(clear, lambda y: y["x"])).otherwise(F.col("_line")).alias("_spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, columns named in keep, text, base and spans array<struct<start, ord, kind, end, score>>.

    base and spans are sorted by start, then kind. Base kinds always stay; an added kind (IBAN by mod 97, national id by
    context) stays when its score reaches ACCEPT and it overlaps no base span. Context is the text on both sides of a span,
    up to CONTEXT_CHARS characters and to the neighbouring match of the kind. Null text counts as empty and has no spans;
    null ids, repeated rows and empty tables pass through; columns not named are ignored, and no name can clash inside.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("_k0"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep, 1)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    return _spans(named).select(F.col("_k0").alias("doc_id"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep, 1)], F.col("_text").alias("text"), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest per document: counts by base kind, the hash of the base spans, all spans and their highest score.

    Null and empty texts have counts of 0, the hash of the empty string, empty spans and a null score; every row, repeated
    or without an id too, gives one row, an empty table none; other columns are ignored.
    """
    found = find_pii(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        F.array_max(F.transform("spans", lambda x: x["score"])).alias("max_score"),
    )


def redact_pii(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans become one. n_chars follows the text.

    A null text stays null. Columns, their order and their names are those of docs, whatever the names; rows are neither
    dropped nor merged; an empty table stays empty. A mask holds nothing that a pattern matches.
    """
    names = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(names)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    found = _spans(numbered)
    # A span that starts before the reach of the spans before it belongs to their mask. Each block of spans cuts its own
    # stretch out of the text once.
    reach = F.when(F.size("_spans") > 0, _running(F.transform("_spans", lambda x: x["end"]), F.greatest))
    found = found.select(*[f"_k{i}" for i in range(len(names))], "_text", "_spans", reach.alias("_reach"))
    cuts = F.zip_with("_spans", F.concat(F.array(F.lit(0)), F.slice("_reach", F.lit(1), F.size("_spans") - 1)), lambda x, r: F.struct(r.alias("a"), x["start"].alias("b"), x["kind"].alias("kind")))
    found = found.select("*", F.when(F.size("_spans") > 0, cuts).alias("_cuts"))

    def masked(block: Column) -> Column:
        first = F.element_at(block, 1)["a"]
        far = F.element_at(block, -1)["b"]
        stretch = F.substring(F.col("_text"), first + 1, F.greatest(far - first, F.lit(0)))
        one = lambda t: F.array_join(F.transform(block, lambda x: F.when(x["b"] >= x["a"], F.concat(F.substring(t, x["a"] - first + 1, x["b"] - x["a"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")), "")
        return F.element_at(F.transform(F.array(stretch), one), 1)

    tail = F.expr("substring(_text, element_at(_reach, -1) + 1)")
    done = F.concat(F.array_join(F.transform(_blocks(F.col("_cuts")), masked), ""), tail)
    text_key = f"_k{names.index(text_col)}"
    found = found.select(*[f"_k{i}" for i in range(len(names))], F.when(F.col(text_key).isNull(), F.lit(None).cast("string")).when(F.size("_spans") == 0, F.col("_text")).otherwise(done).alias("_new"))
    cols = []
    for i, c in enumerate(names):
        if c == text_col:
            cols.append(F.col("_new").alias(c))
        elif c == n_chars_col:
            cols.append(F.when(F.col("_new").isNull(), F.col(f"_k{i}")).otherwise(F.length("_new").cast("long")).alias(c))
        else:
            cols.append(F.col(f"_k{i}").alias(c))
    return found.select(*cols)
