"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score. DataFrame operations only.

Base kinds (email, ip, card, phone) keep every leftmost non-overlapping match that passes its check. The method adds `iban`
(mod-97 holds) and `pan` (13 to 15 digits that pass Luhn, with a payment word nearby). A span's score is that of its kind,
more for a checksum, more for a word of its context within 40 code points before or 20 after. Added kinds need `least`.

Patterns are written so that the Java engine stays linear on long runs of one class: a match may start only where a run
starts or the last match ended, and runs do not backtrack. Texts without a kind's tell-tale skip its work. Lists of matches
grow in blocks and texts are looked into by chunks of CHUNK code points, so a long text with a match in every line
costs its length and not its square.

Cases: null text is the empty text. Offsets are code points in the whole text, end exclusive. Empty table: empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import let, listed
from larkspur.session import unused

CHUNK = 4096
#: The kinds' patterns. Each gives the same matches as its plain form in the docstring of `find`.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
#: The first four characters of an IBAN, not within a longer run; its group holds what may follow them. Spans may overlap.
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(" + IBAN.removeprefix("[A-Z]{2}[0-9]{2}") + "))"
#: Length: countries, as in the registry of ISO 13616.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: kind: (tell-tale, pattern, score, for a checksum, context words)
KINDS = {
    "email": (None, EMAIL, 0.8, 0.0, "mail|contact|write to|correo|courriel"),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", IP, 0.6, 0.0, r"\bip\b|address|host|server|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", CARD, 0.4, 0.4, "card|visa|credit|debit|payment|karte|carte|tarjeta"),
    "phone": (r"\+[0-9]", PHONE, 0.5, 0.0, "phone|call|tel|mobile|fax|llam"),
    "iban": (r"[A-Z]{2}[0-9]{2}", IBAN, 0.4, 0.4, "iban|bank|account|konto|compte|cuenta"),
    "pan": (r"[0-9](?:[\x20-]?[0-9]){12}", CARD, 0.2, 0.2, "card|visa|amex|credit|debit|payment|karte|carte|tarjeta"),
}
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int,score:double,hit:string>>"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(pieces: Column, start: Column, n: Column) -> Column:
    """n code points of the text from `start` (from 0), from its chunks; what lies beyond the end is left out."""
    first = F.floor(start / CHUNK).cast("int")
    own = F.array_join(F.slice(pieces, first + 1, F.floor((start % CHUNK + n) / CHUNK).cast("int") + 1), "")
    return F.substring(own, (start % CHUNK + 1).cast("int"), n)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of all matches, which may not be empty. The texts between matches give the offsets."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(at, x):
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return end, F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))

    # there is one gap more than hits; it meets no hit
    pairs = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), lambda x: x["hit"].isNotNull())
    return listed(pairs, F.lit(0), "struct<start:int,end:int,hit:string>", step)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def value(i):
        d = F.try_to_number(F.substring(F.reverse(number), i + 1, F.lit(1)), F.lit("9")).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(number) - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count 10 to 35, the remainder is 1."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(acc, c):
        code = F.ascii(c)
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def byte_sized(part: Column) -> Column:
    """A number of at most 255, whatever its leading zeros."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(bare) > 3, False).otherwise(bare.cast("int") <= 255)


def passes(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), byte_sized)
    n = F.length(digits(hit))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(hit, " ", ""))
    low, high = (16, 19) if kind == "card" else (13, 15)
    return F.when(n.between(low, high), luhn(digits(hit))).otherwise(False)


def accounts(text: Column, pieces: Column) -> Column:
    """array<struct<start, end, hit>> of the IBANs: at each head, the span of its country's length or else the longest span that
    the pattern takes, whichever first holds mod-97 and ends where no letter or digit follows. An IBAN within another is none."""
    heads, rests = matches(text, IBAN_HEAD), F.regexp_extract_all(text, F.lit(IBAN_HEAD), F.lit(1))
    longest = F.zip_with(heads, rests, lambda m, rest: F.struct(m["start"].alias("start"), F.concat(m["hit"], rest).alias("hit")))
    lengths = F.create_map(*[F.lit(x) for n, codes in IBAN_LENGTHS.items() for code in codes.split() for x in (code, n)])

    def spans_at(m):
        hit = m["hit"]
        places = F.filter(F.sequence(F.lit(1), F.length(hit)), lambda i: F.substring(hit, i, F.lit(1)) != " ")
        own = F.get(places, F.try_element_at(lengths, F.substring(hit, 1, 2)) - 1)
        sizes = F.filter(F.array(own, F.length(hit)), lambda n: n.isNotNull())
        spans = F.transform(sizes, lambda n: F.struct(m["start"].alias("start"), (m["start"] + n).alias("end"), F.substring(hit, F.lit(1), n).alias("hit")))
        return F.slice(F.filter(spans, lambda x: ~part(pieces, x["end"], F.lit(1)).rlike("[A-Za-z0-9]") & passes("iban", x["hit"])), 1, 1)

    def step(end, x):
        apart = x["start"] >= end
        return F.when(apart, x["end"]).otherwise(end), F.when(apart, F.array(x)).otherwise(F.array())

    return listed(F.flatten(F.transform(longest, spans_at)), F.lit(0), "struct<start:int,end:int,hit:string>", step)


def find(text: Column, kind: str, least: float = 0.6) -> Column:
    """The kind's spans. Plain forms of the base patterns:
    email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+; ip [0-9]+(\\.[0-9]+){3}; card [0-9]([\\x20-]?[0-9])+ (here with
    single digits too, which no check passes); phone as it is."""
    tell, pattern, score, checked, words = KINDS[kind]
    seen = F.contains(text, F.lit("@")) if tell is None else F.rlike(text, F.lit(tell))

    def spans(pieces):
        good = accounts(text, pieces) if kind == "iban" else F.filter(matches(text, pattern), lambda m: passes(kind, m["hit"]))

        def scored(m):
            before = F.greatest(F.lit(0), m["start"] - 40)
            near = F.lower(F.concat(part(pieces, before, m["start"] - before), F.lit(" "), part(pieces, m["end"], F.lit(20))))
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), (F.lit(score + checked) + F.when(near.rlike(words), 0.2).otherwise(0.0)).alias("score"), m["hit"].alias("hit"))

        found = F.transform(good, scored)
        return found if kind in BASE else F.filter(found, lambda s: s["score"] >= least)

    return F.when(seen, let(chunks(text), spans)).otherwise(F.array()).cast(SPAN)


def spans(docs: DataFrame, text_col: str = "text", least: float = 0.6, keep: list[str] | None = None, own: tuple[str, str] = ("base", "added")) -> DataFrame:
    """docs (or its columns `keep`) with `base` and `added` (or the names `own`, which replace columns so named): arrays of spans by kind as listed, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, added = (F.concat(*[find(text, k, least) for k in kinds]) for kinds in (BASE, [k for k in KINDS if k not in BASE]))
    return docs.select(*(c for c in keep or docs.columns if c not in own), base.alias(own[0]), added.alias(own[1]))


def listing(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", least: float = 0.6) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; of spans that overlap, the first (then longest) names the
    replacement, which covers them all. A null text stays null, a text without spans as it is."""
    base, added, ordered, new = unused(docs.columns, "base", "added", "ordered", "new")
    found = spans(docs, text_col, least, own=(base, added))
    by_start = F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    text = F.col(text_col)

    def written(pieces):
        def step(at, s):
            kept = F.array(part(pieces, at, s["start"] - at), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            return F.greatest(at, -s["neg"]), F.when(s["start"] >= at, kept).otherwise(F.array())

        last = F.array_max(F.transform(ordered, lambda s: -s["neg"]))
        return F.concat(F.array_join(listed(F.col(ordered), F.lit(0), "string", step), ""), part(pieces, last, F.greatest(F.lit(0), F.length(text) - last)))

    marked = F.size(ordered) > 0
    out = found.withColumn(ordered, by_start).withColumn(new, F.when(marked, let(chunks(text), written)).otherwise(text))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(new).alias(c))
        elif c == count_col:
            columns.append(F.when(marked, F.length(new)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)
