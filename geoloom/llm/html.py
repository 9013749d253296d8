"""Main text of web pages by wrappers inferred per host.

A page is a stream of tags and texts.  Streams of the same host are aligned one after another into
a wrapper, an expression without unions: what repeats side by side becomes a repeated group, what
one page has and another has not becomes an optional group, and texts that differ become slots.
Every page of a host takes part: pages of the same structure are put together first, then the
structures are aligned in rounds.  The wrapper says of every container path of the host whether its
texts vary between pages, and which containers hold the main text of which pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow_text import slices, tidy
from geoloom.session import checkpoint, checkpoint_root

#: Wrappers of a host that a round aligns in one group, on average.
FAN_IN = 16
#: Tokens of the structures that a task holds before it sends them on.
HELD_NODES = 1 << 18
#: Share of a host's varying text that the main container must hold where no tag names it.
MAIN_SHARE = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|</?[a-zA-Z](?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+>"""
    r"|</?[a-zA-Z][^<>]*(?:>|\Z)"
    r"|[^<]++|<",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NUMBER = re.compile("[0-9]+")
_HINT_WORD = re.compile("[a-z]+")

#: Fixed word lists.  Elements that flow within a line:
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold others and so make up the path of a text:
CONTAINERS = frozenset(
    "html head body title div section article main nav header footer aside form ul ol dl table thead tbody tfoot tr td th figure blockquote fieldset dialog details menu address button select object".split()
)
#: Containers that are never main text:
ASIDE = frozenset("head title nav footer aside form button select dialog menu".split())
#: Containers that name the main text, as tags and as words of class, id or role:
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
#: Words of class, id or role that name something else:
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)


def tokens(page: str) -> list[tuple[str, str]]:
    """(key, text) of a page: tags with their class, id and role, texts under the key ``#``."""
    out = []
    for m in _TOKEN.finditer(page):
        raw = m[0]
        if raw[0] != "<" or len(raw) == 1:
            out.append(("#", raw))
        elif m[1] is None and raw[1] not in "!?":
            name = _NAME.match(raw)[1].lower()
            if raw[1] == "/":
                out.append((f"</{name}>", ""))
            else:
                named = " ".join(x for g in _NAMED.findall(raw) for x in g if x).lower() if " " in raw else ""
                out.append((f"<{name} {_NUMBER.sub('0', named)}>" if named else f"<{name}>", ""))
        else:
            out.append(("", " "))
    return out


def _stream(toks: list[tuple[str, str]]) -> list[int]:
    """Places of the tokens that count: tags and texts with ink."""
    return [i for i, (key, text) in enumerate(toks) if (key and key != "#") or (key and text.strip())]


class Node:
    """A tag, a text or a repeated group; ``group`` numbers the optional group it belongs to.

    ``text`` is the hash of a text, None where texts differ; ``paths`` has the characters of a text
    and those of them in links, by the container path that they have on their page.
    """

    __slots__ = ("body", "group", "key", "keep", "paths", "text")

    def __init__(self, key: str, text: int | None = None, body: list[Node] | None = None, paths: dict[str, list[int]] | None = None):
        self.key, self.text, self.body, self.paths = key, text, body, paths
        self.group: int | None = None
        self.keep = False


def _merge(a: Node, b: Node) -> None:
    """b's evidence into a, which has the same key."""
    if a.text != b.text:
        a.text = None
    for path, (chars, linked) in (b.paths or {}).items():
        mine = a.paths.setdefault(path, [0, 0])
        mine[0] += chars
        mine[1] += linked
    for x, y in zip(a.body or (), b.body or ()):
        _merge(x, y)


def fold_repeats(nodes: list[Node]) -> list[Node]:
    """Repetitions side by side as groups, shortest period first, whatever the period."""
    names: dict[str, int] = {}
    number = lambda nodes: np.array([names.setdefault(n.key, len(names)) for n in nodes], np.int64)
    keys, period = number(nodes), 1
    while 2 * period <= len(nodes):
        same = np.flatnonzero(np.diff(np.concatenate(([0], keys[:-period] == keys[period:], [0]))))
        # runs of places that equal the place a period later; a repetition needs a whole period of them
        runs = [(x, y) for x, y in zip(same[::2].tolist(), same[1::2].tolist()) if y - x >= period]
        out, done = [], 0
        for x, y in runs:
            i = max(x, done)
            times = (y - i) // period + 1
            body = nodes[i : i + period]
            if times < 2 or not any(n.key[0] in "#(" for n in body):
                continue
            for k in range(i + period, i + times * period):
                _merge(body[(k - i) % period], nodes[k])
            out += nodes[done:i]
            out.append(Node("(" + "".join(n.key for n in body) + ")+", body=body))
            done = i + times * period
        if done:
            nodes = out + nodes[done:]
            keys = number(nodes)
        period += 1
    return nodes


def _fold_known(nodes: list[Node], groups: list[Node]) -> list[Node]:
    """Single occurrences of groups that another page repeats, as groups too."""
    for g in sorted(groups, key=lambda g: -len(g.body)):
        want, out, i = [n.key for n in g.body], [], 0
        while i < len(nodes):
            part = nodes[i : i + len(want)]
            if [n.key for n in part] == want and len({n.group for n in part}) == 1:
                out.append(Node(g.key, body=part))
                out[-1].group = part[0].group
                for n in part:
                    n.group = None
                i += len(want)
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def page_nodes(page: str) -> list[Node]:
    toks, path, nodes = tokens(page), _Path(), []
    for i in _stream(toks):
        key, text = toks[i]
        if key == "#":
            text = text.strip()
            nodes.append(Node(key, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")), None, {path.name(): [len(text), len(text) * path.links]}))
        else:
            path.step(key)
            nodes.append(Node(key))
    return fold_repeats(nodes)


def align(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper made to cover one more page, or another wrapper."""
    repeats = lambda nodes: [n for n in nodes if n.body]
    page = _fold_known(page, repeats(wrapper))
    wrapper = _fold_known(wrapper, repeats(page))
    out: list[Node] = []
    fresh, last = -1, None

    def put(n: Node, belongs: tuple) -> None:
        """A node that is optional here; those that come and go together are one group."""
        nonlocal fresh, last
        if belongs != last:
            fresh, last = fresh + 1, belongs
        n.group = fresh
        out.append(n)

    matcher = SequenceMatcher(None, [n.key for n in wrapper], [n.key for n in page], autojunk=False)
    for block, (what, a, b, c, d) in enumerate(matcher.get_opcodes()):
        if what == "equal":
            for x, y in zip(wrapper[a:b], page[c:d]):
                _merge(x, y)
                if x.group is None and y.group is None:
                    out.append(x)
                    last = None
                else:
                    put(x, (block, x.group, y.group))
            continue
        for n in wrapper[a:b]:
            put(n, (block, "wrapper", n.group))
        for n in page[c:d]:
            put(n, (block, "page", n.group))
    return out


def _name(key: str) -> str:
    return key[1:-1].split(" ")[0].lstrip("/")


class _Path:
    """The containers and links that are open at a place of a stream."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.links = 0
        self._name: str | None = ""

    def name(self) -> str:
        if self._name is None:
            self._name = "\0".join(self.open)
        return self._name

    def step(self, key: str) -> None:
        name = _name(key)
        if name == "a":
            self.links = int(key[1] != "/")
        elif name in CONTAINERS:
            self._name = None
            if key[1] != "/":
                self.open.append(key)
            else:
                for i in range(len(self.open) - 1, -1, -1):
                    if _name(self.open[i]) == name:
                        del self.open[i:]
                        break


def _words(key: str) -> set[str]:
    return set(_HINT_WORD.findall(key.partition(" ")[2]))


@lru_cache(maxsize=65536)
def _is_main(key: str) -> bool:
    return _name(key) in MAIN_TAGS or bool(_words(key) & MAIN_WORDS) and not _words(key) & ASIDE_WORDS


@lru_cache(maxsize=65536)
def _is_aside(key: str) -> bool:
    return _name(key) in ASIDE or (_name(key) not in MAIN_TAGS | {"html", "body"} and bool(_words(key) & ASIDE_WORDS))


def _aside(path: tuple[str, ...]) -> bool:
    """In a container of another kind, or in a page header outside the main text."""
    main = False
    for key in path:
        if _is_aside(key) or (_name(key) == "header" and not main):
            return True
        main = main or _is_main(key)
    return False


def _texts(nodes: list[Node]) -> Iterator[Node]:
    for n in nodes:
        if n.body:
            yield from _texts(n.body)
        elif n.key == "#":
            yield n


def templates(nodes: list[Node]) -> dict[frozenset, dict[str, list[int]]]:
    """Characters and those in links by container path, of pages by the set of their paths."""
    sums: dict[str, list[int]] = {}
    for n in _texts(nodes):
        for name, (chars, linked) in n.paths.items():
            mine = sums.setdefault(name, [0, 0])
            mine[0] += chars
            mine[1] += linked
    return {frozenset(sums): sums}


def _add(a: dict[frozenset, dict[str, list[int]]], b: dict[frozenset, dict[str, list[int]]]) -> None:
    for names, sums in b.items():
        mine = a.setdefault(names, {})
        for name, (chars, linked) in sums.items():
            had = mine.get(name, (0, 0))
            mine[name] = [had[0] + chars, had[1] + linked]


def _parts_of(name: str) -> tuple[str, ...]:
    return tuple(name.split("\0")) if name else ()


@lru_cache(maxsize=65536)
def _named(name: str) -> bool:
    """A path whose containers name the main text."""
    path = _parts_of(name)
    return any(map(_is_main, path)) and not _aside(path)


def _under(name: str, main: str) -> bool:
    return not main or name == main or name.startswith(main + "\0")


def judge(wrapper: list[Node], kinds: dict[frozenset, dict[str, list[int]]], pages: int) -> dict:
    """Paths with varying text, and the containers of main text, most common first.

    Pages whose containers name the main text need neither.  Of the others, the deepest container
    with most of their varying text is the first; pages that have none of it give the next, and so
    on until every page with varying text has its own.  ``pages`` is the number of different pages;
    of a single one every text counts as varying.
    """
    text, links, varies = Counter(), Counter(), Counter()
    for n in _texts(wrapper):
        for name, (chars, linked) in n.paths.items():
            text[name] += chars
            links[name] += linked
            if (n.text is None or pages == 1) and chars > linked:
                varies[name] += chars - linked
    # a container without varying text is part of the frame, and so is one that is mostly links
    lively = {name for name in varies if links[name] <= text[name] / 2 and not _aside(_parts_of(name))}
    mains: list[str] = []
    rest = [sums for names, sums in kinds.items() if not any(map(_named, names))]
    while rest := [sums for sums in rest if any(name in lively and not any(_under(name, m) for m in mains) for name in sums) and not any(name in lively and _under(name, m) for name in sums for m in mains)]:
        total, held = 0.0, Counter()
        for sums in rest:
            for name, (chars, linked) in sums.items():
                if name in lively:
                    weight = (chars - linked) * varies[name] / max(1, text[name] - links[name])
                    total += weight
                    path = _parts_of(name)
                    for k in range(len(path) + 1):
                        held["\0".join(path[:k])] += weight
        mains.append(max((m for m, v in held.items() if v >= MAIN_SHARE * total * (1 - 1e-9)), key=lambda m: (len(_parts_of(m)), m)))
    for n in _texts(wrapper):
        n.keep = any(_named(name) or name in lively and any(_under(name, m) for m in mains) for name in n.paths)
    return {"mains": mains, "paths": sorted(lively)}


def infer(pages: list[str]) -> str:
    """The wrapper of some pages of one host, as JSON."""
    wrapper: list[Node] = []
    kinds: dict[frozenset, dict[str, list[int]]] = {}
    for k, page in enumerate(pages):
        nodes = page_nodes(page)
        _add(kinds, templates(nodes))
        wrapper = align(wrapper, nodes) if k else nodes
    verdict = judge(wrapper, kinds, len(set(pages)))
    return json.dumps({"nodes": [_plain(n) for n in wrapper], **verdict})


def _packed(nodes: list[Node], kinds: dict[frozenset, dict[str, list[int]]]) -> bytes:
    def plain(n: Node) -> tuple:
        return n.key, n.text, n.paths, n.group, [plain(x) for x in n.body] if n.body else None

    return zlib.compress(pickle.dumps(([plain(n) for n in nodes], list(kinds.values())), pickle.HIGHEST_PROTOCOL), 1)


def _unpacked(data: bytes) -> tuple[list[Node], dict[frozenset, dict[str, list[int]]]]:
    def node(key: str, text: int | None, paths: dict | None, group: int | None, body: list | None) -> Node:
        n = Node(key, text, [node(*x) for x in body] if body else None, paths)
        n.group = group
        return n

    nodes, kinds = pickle.loads(zlib.decompress(data))
    return [node(*x) for x in nodes], {frozenset(sums): sums for sums in kinds}


def _plain(n: Node) -> list:
    return [n.key, n.keep, [_plain(x) for x in n.body] if n.body else None, n.group]


@lru_cache(maxsize=4096)
def _load(wrapper: str) -> dict:
    rules = json.loads(wrapper)
    return {"mains": rules["mains"], "paths": frozenset(rules["paths"])}


def _match(nodes: list, keys: list[str], i: int, marks: list[tuple[int, bool]]) -> int | None:
    """End of the nodes' match from place i on, noting the texts; None if they don't match."""
    k = 0
    while k < len(nodes):
        key, keep, body, group = nodes[k]
        if group is not None:
            end = k
            while end < len(nodes) and nodes[end][3] == group:
                end += 1
            mine: list[tuple[int, bool]] = []
            upto = _match([[*n[:3], None] for n in nodes[k:end]], keys, i, mine)
            if upto is not None:
                marks += mine
                i = upto
            k = end
            continue
        if body:
            times = 0
            while i < len(keys):
                mine = []
                upto = _match(body, keys, i, mine)
                if upto is None or upto == i:
                    break
                marks += mine
                i, times = upto, times + 1
            if not times:
                return None
        elif i < len(keys) and keys[i] == key:
            if key == "#":
                marks.append((i, keep))
            i += 1
        else:
            return None
        k += 1
    return i


def _by_path(keys: list[str], rules: dict) -> list[int]:
    """Places of the main texts of a page."""
    path, at = _Path(), []
    for i, key in enumerate(keys):
        if key == "#":
            at.append((i, path.name()))
        else:
            path.step(key)
    if own := [i for i, name in at if _named(name)]:
        return own
    for main in rules["mains"]:
        if own := [i for i, name in at if name in rules["paths"] and _under(name, main)]:
            return own
    return []


def extract(page: str | None, wrapper: str) -> str:
    """Main text of a page: blocks in order, white space as single spaces."""
    if not page:
        return ""
    toks, rules = tokens(page), _load(wrapper)
    places = _stream(toks)
    keys = [toks[i][0] for i in places]
    kept = {places[i] for i in _by_path(keys, rules)}
    out = []
    for i, (key, text) in enumerate(toks):
        if i in kept:
            out.append(entities.unescape(text))
        elif key in ("#", "") or _name(key) not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def host(url_col: str = "url"):
    """Host of a URL in lower case; what has none belongs to the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PARTS = "host string, sig binary, lo long, hi long, nodes binary"


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages put together by host and structure, as far as a task can hold them."""
    held: dict[tuple[str, bytes], list] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        cols = [[k[0] for k in held], [k[1] for k in held], [v[0] for v in held.values()], [v[1] for v in held.values()], [_packed(*v[2:]) for v in held.values()]]
        types = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["host", "sig", "lo", "hi", "nodes"])

    for batch in batches:
        for part in slices(batch, "t"):
            for where, page, order in zip(part.column("host").to_pylist(), part.column("t").to_pylist(), part.column("o").to_pylist()):
                nodes = page_nodes(page)
                sig = hashlib.blake2b("\0".join(n.key for n in nodes).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                same = held.get((where, sig))
                if same is None:
                    held[where, sig] = [order, order, nodes, templates(nodes)]
                    size += len(nodes)
                else:
                    same[0], same[1] = min(same[0], order), max(same[1], order)
                    _add(same[3], templates(nodes))
                    for x, y in zip(same[2], nodes):
                        _merge(x, y)
                if size > HELD_NODES:
                    yield rows()
                    held, size = {}, 0
    if held:
        yield rows()


def _joined(group: pd.DataFrame, put) -> pd.DataFrame:
    group = group.sort_values("sig", kind="stable")
    wrapper, kinds = _unpacked(group["nodes"].iloc[0])
    for data in group["nodes"].iloc[1:]:
        nodes, more = _unpacked(data)
        _add(kinds, more)
        wrapper = put(wrapper, nodes)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "sig": [group["sig"].iloc[0]], "lo": [group["lo"].min()], "hi": [group["hi"].max()], "nodes": [_packed(wrapper, kinds)]})


def _same(group: pd.DataFrame) -> pd.DataFrame:
    """Parts of one structure as one: nothing to align."""

    def put(a: list[Node], b: list[Node]) -> list[Node]:
        for x, y in zip(a, b):
            _merge(x, y)
        return a

    return _joined(group, put)


def _aligned(group: pd.DataFrame) -> pd.DataFrame:
    return _joined(group, align)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = batch.to_pydict()
        out = [json.dumps(judge(*_unpacked(n), 1 if lo == hi else 2)) for n, lo, hi in zip(c["nodes"], c["lo"], c["hi"])]
        yield pa.RecordBatch.from_arrays([pa.array(c["host"], pa.string()), pa.array(out, pa.string())], ["host", "wrapper"])


def wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of every host, inferred from all of its pages; of the wrapper, what ``judge`` says.

    Tasks put pages of the same host and structure together before the shuffle, which loses nothing:
    a slot is either the same text everywhere or not, and characters add up.  Then the different
    structures of a host are aligned, some at a time, until each host has one wrapper.
    """
    rows = pages.where(F.col(html_col).isNotNull()).select(host(url_col).alias("host"), F.col(html_col).alias("t"), F.xxhash64(html_col).alias("o"))
    parts = checkpoint(rows.mapInArrow(tidy(_structures), _PARTS).groupBy("host", "sig").applyInPandas(_same, _PARTS))
    turn = 0
    while True:
        many = checkpoint(parts.groupBy("host").agg(F.count("*").alias("n")).where("n > 1"))
        if many.isEmpty():
            break
        # the seed changes by round, so that wrappers which met none meet others
        bucket = F.when(F.col("n") <= FAN_IN, 0).otherwise(F.pmod(F.xxhash64("sig", F.lit(turn)), F.ceil(F.col("n") / FAN_IN)))
        open_ = parts.join(many, "host").select("*", bucket.cast("long").alias("bucket")).drop("n")
        met = open_.groupBy("host", "bucket").applyInPandas(lambda g: _aligned(g.drop(columns="bucket")), _PARTS)
        parts = checkpoint(parts.join(many, "host", "left_anti").unionByName(met))
        turn += 1
    return parts.select("host", "lo", "hi", "nodes").mapInArrow(tidy(_judged), "host string, wrapper string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page.

    Null html is an empty page with empty text.  A null or odd URL puts a page among those without a
    host.  Each row gives a row, repeated rows and null ids included; no rows give no rows.  Other
    columns are ignored.  Wrappers are written to the shared folder and read again, so that their
    size is known when the join is planned; a host with very many pages is split by the join.
    """
    spark = pages.sparkSession
    at = f"{checkpoint_root(spark)}/wrappers-{uuid4().hex}"
    wrappers(pages, id_col, url_col, html_col).write.parquet(at)
    known = spark.read.parquet(at)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("t"), host(url_col).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                out = [extract(t, w) if w else "" for t, w in zip(part.column("t").to_pylist(), part.column("wrapper").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["id", "url", "text", "n_chars"]
                )

    joined = rows.join(known, "host", "left").select("id", "url", "t", "wrapper")
    return joined.mapInArrow(tidy(run), "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
