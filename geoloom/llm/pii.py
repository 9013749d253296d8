"""Personal data by fixed patterns and by bootstrapped contexts.

The fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers.  These
are the seeds.  Every other token with a digit or an @ is a candidate, and so are numbers written
with spaces.  The words before and after a token are its lexical patterns; what kinds its own
characters allow is a check apart from them.  Spark scores the graph of patterns and instances in
rounds: a pattern is as good as its known identifiers against what speaks against it, an instance
as good as its patterns, and good patterns find instances that their kind's check allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow_text import slices, tidy
from geoloom.llm.columns import unused
from geoloom.session import checkpoint

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, taken apart so that no text makes them slow (fixed values).  A local part
#: never holds an @, so an address is what stands between the last @ or address and this @, and the
#: domain after it.  An IP address is four numbers in a row of numbers with dots between them.
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGITS = re.compile("[0-9]+")
_NOT_DIGIT = re.compile("[^0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HEAD, _TAIL = "\"'([{<`*#$%&!=:;,", "\"')]}>`*#$%&!?.,:;="
#: Numbers in groups, and the coarse forms of the kinds; dates and decimals are no phone numbers.
_RUN = re.compile(r"(?:\+\x20?)?\(?[0-9]++(?:[\x20().-]{1,2}+[0-9]++)*+")
_MAIL_FORM = re.compile(r"[^@\s]*[^\W_][^@\s]*@[^@\s]*[^\W_][^@\s]*")
_IP_FORM = re.compile(r"[0-9]+(\.[0-9]+){3}")
_IP6_FORM = re.compile(r"[0-9a-f]{0,4}(:[0-9a-f]{0,4}){3,7}")
_CARD_FORM = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE_FORM = re.compile(r"\+?[\x20().0-9/-]+")
_NO_PHONE = re.compile(r"[0-9]+\.[0-9]+|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}")

ROUNDS = 3
#: A pattern must be seen with so many different known identifiers, and with little against it.
MIN_SEEDS = 3
ACCEPT = 0.9
#: Words on either side that make up a pattern.
REACH = 2


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in LOCAL_PART:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        floor = domain.end() if domain else at + 1
        if domain:
            yield begin, floor
        at = text.find("@", floor)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in NUMBERS.finditer(text):
        parts, begin = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield begin, end
            begin = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap in each kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(a, 1, b) for a, b in _addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def forms(token: str) -> tuple[int, int]:
    """(kinds that the characters allow, those of them whose fixed check fails), as bits."""
    n = sum(c in "0123456789" for c in token)
    if "@" in token:
        return (1 if len(token) <= 320 and _MAIL_FORM.fullmatch(token) else 0), 0
    if _IP_FORM.fullmatch(token):
        allowed, refused = 2, 2
    else:
        allowed, refused = (2 if n and len(token) <= 39 and _IP6_FORM.fullmatch(token) else 0), 0
    if 12 <= n <= 19 and _CARD_FORM.fullmatch(token):
        allowed |= 4
        refused |= 4 * (n >= 14)
    if 7 <= n <= 15 and _PHONE_FORM.fullmatch(token) and not _NO_PHONE.fullmatch(token) and not allowed & 2:
        allowed |= 8
    return allowed, refused


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, int, int, list[str]]]:
    """(start, end, kind or -1, instance, allowed, refused, patterns) of the seeds and the candidates of a text."""
    found = [(a, b, k) for a, k, b in spans]
    taken = sorted((a, b) for a, _, b in spans)
    runs = _spaced(text, taken)
    k = r = 0
    # a candidate has a digit or an @, so only the words around those are looked at
    spot = re.compile("[0-9@]")
    m = spot.search(text)
    while m:
        begin, end = m.start(), m.end()
        while begin and not _is_space(text[begin - 1]):
            begin -= 1
        while end < len(text) and not _is_space(text[end]):
            end += 1
        token = text[begin:end]
        left = token.lstrip(_HEAD)
        a = begin + len(token) - len(left)
        b = a + len(left.rstrip(_TAIL))
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        while r < len(runs) and runs[r][1] <= a:
            r += 1
        free = k == len(taken) or taken[k][0] >= b
        # a group of a spaced number is a candidate only if it could be an identifier by itself
        if free and b > a and (r == len(runs) or runs[r][0] >= b or forms(text[a:b].lower())[0]):
            found.append((a, b, -1))
        m = spot.search(text, end)
    found += [(a, b, -1) for a, b in runs]
    return [(a, b, kind, text[a:b].lower(), *forms(text[a:b].lower()), _patterns(text, a, b)) for a, b, kind in sorted(found)]


def _spaced(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Numbers written with spaces that could be identifiers and touch no seed."""
    out, k = [], 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        if text[a] == "(" and ")" not in m[0]:
            a += 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        if whole and b - a <= 40 and " " in text[a:b] and (k == len(taken) or taken[k][0] >= b) and forms(text[a:b])[0]:
            out.append((a, b))
    return out


def _is_space(c: str) -> bool:
    return c == " " or "\t" <= c <= "\r"


def _patterns(text: str, a: int, b: int) -> list[str]:
    before = [w.lower() for w in _WORD.findall(text[max(0, a - 80) : a])[-REACH:]]
    after = [w.lower() for w in _WORD.findall(text[b : b + 80])[:REACH]]
    out = [f"{' '.join(before)} _"] if len(before) == REACH else []
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) == REACH:
        out.append(f"_ {' '.join(after)}")
    return out


_FOUND = "id long, row long, spans array<struct<s:int,k:int,e:int>>, seen array<struct<s:int,e:int,k:int,instance:string,allowed:int,refused:int,patterns:array<string>>>"


def _scan(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """Base spans, seeds and candidates of every row, in one pass over the texts."""
    spans_type = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
    seen_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32()), ("instance", pa.string()), ("allowed", pa.int32()), ("refused", pa.int32()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                spans, seen = [], []
                for text in part.column("t").to_pylist():
                    mine = base_spans(text) if text else []
                    spans.append([{"s": a, "k": k, "e": b} for a, k, b in mine])
                    seen.append([dict(zip(("s", "e", "k", "instance", "allowed", "refused", "patterns"), m)) for m in mentions(text, mine)] if text else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("row"), pa.array(spans, spans_type), pa.array(seen, seen_type)], ["id", "row", "spans", "seen"]
                )

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(run), _FOUND)


def learn(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, accept: float = ACCEPT) -> DataFrame:
    """(instance, kind): candidates that good patterns point to.

    Starts from seeds with score 1 and others with score 0.  The score of a pattern for a kind is
    the summed score of its different instances over that sum, what speaks against the kind and
    one; it counts if it reaches ``accept`` and the sum reaches ``min_seeds``.  Against a kind
    speak identifiers of other kinds that it would allow, and candidates that its form doesn't
    allow or whose fixed check fails; other candidates say nothing.  An instance's score is the
    chance that one of its good patterns is right, for kinds that its form allows.
    """
    m = found.select(F.explode("seen").alias("m")).select("m.*")
    seen = m.select("instance", F.explode("patterns").alias("pattern"), F.col("k").alias("kind"), "allowed", "refused")
    edges = checkpoint(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("allowed").alias("allowed"), F.max("refused").alias("refused")))
    allows = [F.col("allowed").bitwiseAND(1 << k) != 0 for k in range(len(KINDS))]
    fails = [F.col("refused").bitwiseAND(1 << k) != 0 for k in range(len(KINDS))]
    could = [F.count_if((F.col("kind") == k) | ((F.col("kind") < 0) & allows[k])) for k in range(len(KINDS))]
    against = [F.count_if(F.when(F.col("kind") >= 0, (F.col("kind") != k) & allows[k]).otherwise(~allows[k] | fails[k])) for k in range(len(KINDS))]
    # a pattern whose instances would not do for any kind if all were right never counts, so most of the graph goes at once
    size = edges.groupBy("pattern").agg(F.array(*could).alias("could"), F.array(*against).alias("against"))
    size = size.where(F.exists(F.arrays_zip("could", "against"), lambda x: (x.could >= min_seeds) & (x.could / (x.could + x.against + 1) >= accept)))
    graph = checkpoint(edges.join(size.select("pattern", "against"), "pattern"))
    seeds = graph.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    scores = seeds
    for _ in range(rounds):
        mass = (
            graph.drop("kind").join(scores, "instance").groupBy("pattern", "kind")
            .agg(F.sum("score").alias("mass"), F.element_at(F.first("against"), F.col("kind") + 1).alias("counter"))
            .where(F.col("mass") >= min_seeds)
        )
        good = mass.select("pattern", "kind", (F.col("mass") / (F.col("mass") + F.col("counter") + 1)).alias("trust")).where(F.col("trust") >= accept)
        by_pattern = graph.where("kind < 0").drop("kind").join(good, "pattern").where("shiftright(allowed, kind) & 1 = 1").groupBy("instance", "kind")
        told = by_pattern.agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("score"))
        scores = checkpoint(seeds.unionByName(told.select("instance", "kind", "score")))
    named = scores.join(seeds.select("instance").distinct(), "instance", "left_anti").where(F.col("score") >= accept)
    return named.groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """Personal data of every row: (id_col, row, base, spans), both arrays of (s, k, e).

    ``base`` has the spans of the fixed patterns, ``spans`` those and the learned ones, by start and
    kind; k is a place in KINDS, s and e count code points.  Null is an empty text, without spans.
    Every row is looked at by itself, repeated rows and null ids included.  ``row`` tells rows with
    the same id apart.  No rows give no rows.  Other columns are ignored.
    """
    found = checkpoint(_scan(docs, id_col, text_col))
    known = learn(found, **learning)
    more = (
        found.select("row", F.explode("seen").alias("m")).where("m.k < 0").select("row", "m.s", "m.e", "m.instance")
        .join(known, "instance").groupBy("row").agg(F.collect_list(F.struct("s", F.col("kind").alias("k"), "e")).alias("more"))
    )
    spans = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    return found.select("id", "row", "spans").join(more, "row", "left").select(F.col("id").alias(id_col), "row", F.col("spans").alias("base"), spans.alias("spans"))


def as_text(spans: str) -> str:
    """SQL that writes an array of spans as kind:start:end, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.s, x.e)), ',')"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """Counts per kind and digests of the spans of every row; see ``find``."""
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find(docs, id_col, text_col, **learning).select(
        id_col, *counts, F.expr(f"sha2({as_text('base')}, 256)").alias("base_sha256"), F.expr(as_text("spans")).alias("spans")
    )


def masked(text: str | None, spans: list[dict]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans merge."""
    if not text or not spans:
        return text
    out, at = [], 0
    for x in spans:
        if x["s"] >= at:
            out += [text[at : x["s"]], f"[{KINDS[x['k']].upper()}]"]
        at = max(at, x["e"])
    return "".join(out) + text[at:]


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """All rows and columns of ``docs`` with personal data in ``text_col`` replaced by its kind.

    Base spans are found next to the text; learned ones are joined to their rows by id and text
    hash, and only if there are any.
    """
    h, own = unused(docs, "_h"), unused(docs, "_more")
    found = checkpoint(_scan(docs.withColumn(h, F.xxhash64(text_col)), id_col, text_col, h))
    known = checkpoint(learn(found, **learning))
    rows = docs.withColumn(h, F.xxhash64(text_col))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    if known.isEmpty():
        rows = rows.withColumn(own, none)
    else:
        more = (
            found.select("id", "row", F.explode("seen").alias("m")).where("m.k < 0").select("id", "row", "m.s", "m.e", "m.instance")
            .join(known, "instance").groupBy("id", "row")
            .agg(F.collect_set(F.struct("s", F.col("kind").alias("k"), "e")).alias("more"))
        )
        same = rows[id_col].cast("long").eqNullSafe(more["id"]) & (rows[h] == more["row"])
        rows = rows.join(more, same, "left").select(*[rows[c] for c in docs.columns], F.coalesce(more["more"], none).alias(own))

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                out = []
                for text, more_ in zip(part.column(text_col).to_pylist(), part.column(own).to_pylist()):
                    spans = [{"s": a, "k": k, "e": b} for a, k, b in base_spans(text or "")] + more_
                    out.append(masked(text, sorted(spans, key=lambda x: (x["s"], x["k"]))))
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, text_col, pa.array(out, pa.string())).select(names)

    return rows.select(*docs.columns, own).mapInArrow(tidy(run), docs.schema)
