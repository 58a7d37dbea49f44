"""Main text of web pages by equivalence-class template deduction.

Tokens are the elements of a page, told apart by their path of tags, classes and ids, and its blocks
of text. The occurrence vector of a token says how often it occurs on each page of its host; tokens
that share a vector form an equivalence class. A path that occurs the same number of times, over once,
on nearly all its pages plays a different role at each place, so it is told apart by its place and the vectors
are taken again. A class is valid if its tokens keep one order on the host's pages; it nests in the
slot of the nearest element of another valid class. The template's elements and texts are those of
frequent valid classes; the article is the slot that holds the host's varying text, and what remains in
it, less the template's own texts and furniture, is the main text. Tags and class words say what is
furniture in a slot, and decide between slots only where the vectors leave a choice.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, long_rows, materialize, table
from .url_filter import parts

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|object|canvas|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
OF_OTHERS = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|no)[-_][\w-]+", re.I)  # has-sidebar says what lies beside

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag ends open elements of these tags, up to a boundary.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
MAIN_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2"])
TEXTUAL = frozenset(
    "b blockquote center code dd dl dt em figcaption figure font h1 h2 h3 h4 h5 h6 i li ol p pre span strong table tbody td th tr ul".split()
)
#: Elements that are never main text.
ASIDE_TAGS = frozenset("head nav footer aside form button select dialog".split())
#: Words of classes, ids and roles of what is no part of an article even inside it.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo newsletter subscribe cookie cookies consent "
    "gdpr popup modal comment comments reply replies discussion disqus respond share sharing social related recommended "
    "recommendations pagination pager breadcrumb breadcrumbs".split()
)
#: Words of what is no part of an article, beside it or inside: of what they mark only headings inside an article stay.
WEAK_WORDS = frozenset(
    "sidebar menu nav navbar navigation masthead footer banner notice notices alert overlay signup subscription promotion "
    "login search form widget toolbar skip copyright legal disclaimer complementary contentinfo".split()
)
#: What is known of a node: it is or lies in furniture, surely or by a weak word; it lies in a main element; its text is a
#: link's; it is a text; it is a heading, a text-level element, the page as a whole, a main element itself, weak by itself.
HARD, WEAK, MAIN, LINK, TEXT, HEADING, LEVEL, WHOLE, IS_MAIN, IS_WEAK = (1 << i for i in range(10))
ROOT, _MASK = 1, (1 << 63) - 1


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) & _MASK


def _mix(a: int, b: int) -> int:
    """A hash of two numbers and their order; that of a tuple of numbers is the same in every process."""
    return hash((a, b)) & _MASK


@lru_cache(1 << 14)
def _element(tag: str, attributes: str) -> tuple[int, int]:
    """Name of an element, and what its words say of it."""
    named, said = _attributes(attributes)
    return _hash(tag + named), said


@dataclass
class Page:
    """Nodes of a page in the order of its source: name, parent's number, flags, characters of a text; the texts themselves."""

    names: list[int] = field(default_factory=lambda: [ROOT])
    ups: list[int] = field(default_factory=lambda: [-1])
    flags: list[int] = field(default_factory=lambda: [WHOLE])
    texts: dict[int, str] = field(default_factory=dict)

    def add(self, name: int, up: int, flags: int) -> int:
        self.names.append(name)
        self.ups.append(up)
        self.flags.append(flags)
        return len(self.names) - 1


@dataclass
class _Open:
    tag: str
    node: int
    flags: int


def _attributes(text: str) -> tuple[str, int]:
    """Class and id as part of a name; what they say of the element."""
    if not text.strip("/ \t\n\r\f"):
        return "", 0
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)}
    named = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    said = {w.lower() for w in WORDS.findall(OF_OTHERS.sub(" ", named))}
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
    flags = (HARD if hidden or said & STRONG else 0) | (WEAK if said & WEAK_WORDS else 0) | (IS_MAIN if found.get("role") == "main" else 0)
    return f".{found.get('class', '')}#{re.sub(r'[0-9]+', '0', found.get('id', ''))}", flags


def _words_only(attributes: str) -> str:
    """The attributes that _attributes() reads, without the others."""
    return " ".join(m[0] for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role", "style", "hidden", "aria-hidden"))


def _judge(tag: str, said: int, inside: int) -> int:
    """Flags of an element by its tag, its words and the flags of where it stands."""
    if tag in ("html", "body"):
        return inside & (HARD | LINK) | WHOLE
    main = said & IS_MAIN or tag in MAIN_TAGS
    hard = inside & HARD or said & HARD or tag in ASIDE_TAGS or tag == "header" and not inside & MAIN
    odd = bool(said & WEAK or tag == "header") and not main  # words of a main element say what it is about
    weak = 0 if main or tag in HEADINGS and inside & MAIN else WEAK if odd else inside & WEAK
    out = (HARD if hard else 0) | weak | (inside | (MAIN if main else 0)) & MAIN | (IS_MAIN if main else 0) | (IS_WEAK if odd else 0)
    return out | (HEADING if tag in HEADINGS else 0) | (LEVEL if tag in TEXTUAL else 0) | (LINK if tag == "a" or inside & LINK else 0)


def parse(source: str) -> Page:
    """Nodes of a page. Unclosed and stray tags are borne with. A run of text between block boundaries is one node."""
    page, stack, run, linked = Page(), [_Open("", 0, WHOLE)], [], 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                top = stack[-1]
                flags = top.flags & (HARD | WEAK | MAIN) | TEXT | (LINK if 2 * linked > sum(map(len, run)) else 0)
                page.texts[page.add(_hash(text), top.node, flags)] = text
            run.clear()
        linked = 0

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    def take(text: str) -> None:
        nonlocal linked
        run.append(text)
        if stack[-1].flags & LINK:
            linked += len(text)

    at = 0
    for m in MARKUP.finditer(source):
        if m.start() > at:
            take(source[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:
                run.append(" ")
            continue
        if tag == "br":
            run.append(" ")
            continue
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                if tag in BLOCK:
                    close(depth)
                elif all(x.tag not in BLOCK for x in stack[depth:]):
                    if any((x.flags ^ stack[depth - 1].flags) & HARD for x in stack[depth:]):
                        flush()
                    del stack[depth:]
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            ended, until = ENDS.get(tag, ({"p"}, ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    close(i)
                    if tag not in ENDS:
                        break
                elif stack[i].tag in until or tag not in ENDS and stack[i].tag in BLOCK:
                    break
        if tag in VOID:
            continue
        name, said = _element(tag, m[4] if len(m[4]) < 200 and tag != "a" else _words_only(m[4]))
        top = stack[-1]
        flags = _judge(tag, said, top.flags)
        if flags & HARD and not top.flags & HARD and tag not in BLOCK:
            flush()
        node = page.add(name, top.node, flags)
        if not m[4].endswith("/") or tag in BLOCK:
            stack.append(_Open(tag, node, flags))
    take(source[at:])
    flush()
    return page


def tokens(names: list[int], ups: list[int], split: frozenset[int]) -> list[int]:
    """The token of each node: the hash of its path; paths in split are told apart by their place on the page."""
    out, seen = [ROOT], {}
    for name, up in zip(names[1:], ups[1:], strict=True):
        path = _mix(out[up], name)
        if path in split:
            seen[path] = place = seen.get(path, 0) + 1
            path = _mix(path, place)
        out.append(path)
    return out


def _columns(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch as Python values; lists of numbers by way of one flat list, which is faster than by scalars."""

    def plain(c: pa.Array) -> list:
        if not pa.types.is_list(c.type) or not pa.types.is_integer(c.type.value_type):
            return c.to_pylist()
        flat, at = c.flatten().to_pylist(), 0
        out = []
        for n in c.value_lengths().fill_null(0).to_pylist():
            out.append(flat[at : at + n])
            at += n
        return out

    return zip(*map(plain, b.columns), strict=True)


def skeletons(named: DataFrame) -> DataFrame:
    """(host, own, names, ups, flags, sizes) of each page (host, html): its nodes, without its texts; own tells pages apart."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, rows = [], []
            for x in b.column(1):
                source = x.as_py()
                page = parse(source)
                own.append(_hash(source))
                rows.append((page.names, page.ups, page.flags, [len(page.texts.get(i, "")) for i in range(len(page.names))]))
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int64()), *arrays], ["host", "own", "names", "ups", "flags", "sizes"])

    few = long_rows(named.select("host", F.coalesce("html", F.lit("")).alias("html")))
    return few.mapInArrow(run, "host string, own long, names array<long>, ups array<int>, flags array<short>, sizes array<int>")


def _told(pages: DataFrame, by_host: DataFrame, size: str, *key: str, most: int = 2_000_000, salts: int = 32) -> DataFrame:
    """pages with what is known of their host: by a broadcast of at most `most` numbers, else by a join in which each host
    is dealt over `salts` tasks by the key of the page."""
    if (by_host.agg(F.sum(F.expr(size))).first()[0] or 0) <= most:
        return pages.join(F.broadcast(by_host), "host", "left")
    spread = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(salts)))
    return dealt.join(spread.hint("merge"), ["host", "salt"], "left").drop("salt")


TALLY = [("token", pa.int64()), ("up", pa.int64()), ("times", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("flags", pa.int32()), ("place", pa.int32()), ("mark", pa.int64())]


def _tally(names: list[int], ups: list[int], flags: list[int], sizes: list[int], own: int, split: frozenset[int]) -> list[tuple]:
    """A row of TALLY for each token of a page: how often it occurs, the text below it outside furniture, the part of it
    that is links, where it comes first, and its share of the occurrence vector."""
    path = tokens(names, ups, split)
    chars, linked = [0] * len(path), [0] * len(path)
    for i in range(len(path) - 1, -1, -1):
        if flags[i] & TEXT and not flags[i] & (HARD | WEAK):
            chars[i] = sizes[i]
            linked[i] = sizes[i] if flags[i] & LINK else 0
        if i:
            chars[ups[i]] += chars[i]
            linked[ups[i]] += linked[i]
    found: dict[int, list[int]] = {}
    for i, t in enumerate(path):
        row = found.get(t)
        if row is None:
            found[t] = [path[ups[i]] if i else 0, 1, chars[i], linked[i], flags[i], i]
        else:
            row[1] += 1
            row[2] += chars[i]
            row[3] += linked[i]
    return [(t, *r, _mix(own, r[1]) >> 32) for t, r in found.items()]


def occurrences(pages: DataFrame) -> DataFrame:
    """Sums over each host's skeletons (and split, a host's paths told apart): one row a token, its vector known by how many
    pages have it, its occurrences and a sum of page hashes, so that vectors are compared without being gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, frozenset())
        for b in batches:
            at, rows = [], []
            hosts = b.column(0)
            for i, (host, own, names, ups, flags, sizes, split) in enumerate(_columns(b)):
                if last[0] != host:
                    last = (host, frozenset(split or ()))
                got = _tally(names, ups, flags, sizes, own, last[1])
                at += [i] * len(got)
                rows += [(own, *r) for r in got]
            kinds = [pa.int64(), *(k for _, k in TALLY)]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([hosts.take(pa.array(at, pa.int32())), *arrays], ["host", "own", *(n for n, _ in TALLY)])

    kinds = "host string, own long, token long, up long, times long, chars long, linked long, flags int, place int, mark long"
    each = pages.select("host", "own", "names", "ups", "flags", "sizes", "split").mapInArrow(run, kinds)
    alike = each.withColumn("each", F.col("times")).groupBy("host", "token", "each").agg(
        F.count(F.lit(1)).alias("on"), *(F.sum(c).alias(c) for c in ("times", "chars", "linked", "mark")),
        F.min("up").alias("up"), F.bit_or("flags").alias("flags"), F.min(F.struct("own", "place")).alias("first"),
    )
    return alike.groupBy("host", "token").agg(
        *(F.sum(c).alias(c) for c in ("on", "times", "chars", "linked", "mark")), F.max(F.struct("on", "each")).alias("usual"),
        F.min("up").alias("up"), F.bit_or("flags").alias("flags"), F.min("first").alias("first"),
    )


def _frequent(sums: DataFrame, frequent: float) -> DataFrame:
    """Tokens on so large a share of their host's pages, with the vector's number and the number of pages."""
    pages = sums.where(F.col("token") == ROOT).select("host", F.col("on").alias("pages"))
    known = sums.join(F.broadcast(pages) if pages.count() <= 200_000 else pages, "host").where(F.col("on") >= F.lit(frequent) * F.col("pages"))
    return known.withColumn("vector", F.xxhash64("on", "times", "mark")).withColumn("place", F.col("first.place")).drop("first")


def out_of_order(ranks: list[int], size: int) -> set[int]:
    """Which ranks of a class of so many tokens break its order on a page, given their ranks as they come.

    Where each occurs once these are all but a longest rising run; else all, if they do not come in turn, over and over.
    """
    if len(ranks) != size:
        return set() if ranks == list(range(size)) * (len(ranks) // size) else set(ranks)
    if ranks == list(range(size)):
        return set()
    ends, at, before = [], [], []
    for i, r in enumerate(ranks):
        n = bisect_left(ends, r)
        ends[n:] = [r] + ends[n + 1 :]
        at[n:] = [i] + at[n + 1 :]
        before.append(at[n - 1] if n else -1)
    i, kept = at[-1], set()
    while i >= 0:
        kept.add(ranks[i])
        i = before[i]
    return set(ranks) - kept


def _disordered(pages: DataFrame, known: DataFrame, largest: float) -> DataFrame:
    """(host, token) of tokens that break the order of their class on over so large a share of their pages.

    The order is that of the class's first page by hash, which all its tokens share.
    """
    order = F.struct("vector", "place", "token")
    classes = known.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("tokens"))  # bounded by the template's size
    told = _told(pages, classes, "size(tokens)", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, {}, {}, frozenset())
        for b in batches:
            rows = []
            for host, names, ups, split, template in _columns(b):
                if last[0] != host:
                    of: dict[int, list[int]] = {}
                    for x in template or ():
                        of.setdefault(x["vector"], []).append(x["token"])
                    last = (host, of, {t: (v, i) for v, ts in of.items() for i, t in enumerate(ts)}, frozenset(split or ()))
                _, of, rank, apart = last
                ranks: dict[int, list[int]] = {}
                for v, i in filter(None, map(rank.get, tokens(names, ups, apart))):
                    ranks.setdefault(v, []).append(i)
                rows += [(host, of[v][i]) for v, found in ranks.items() for i in out_of_order(found, len(of[v]))]
            arrays = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "token"])

    off = told.select("host", "names", "ups", "split", "tokens").mapInArrow(run, "host string, token long")
    off = off.groupBy("host", "token").agg(F.count(F.lit(1)).alias("off"))
    return off.join(known.select("host", "token", "on"), ["host", "token"]).where(F.col("off") > F.lit(largest) * F.col("on")).select("host", "token")


@dataclass
class Template:
    """What a host's pages share: the article's slot, texts of the template in it, furniture; paths told apart."""

    slot: int | None = None
    fixed: frozenset[int] = frozenset()
    furniture: frozenset[int] = frozenset()
    split: frozenset[int] = frozenset()


def nest(rows: list[dict]) -> dict[int, int]:
    """Valid token -> the token whose slot it lies in: its nearest ancestor that is valid."""
    of, out = {r["token"]: r for r in rows}, {}
    for r in rows:
        if r["valid"]:
            up = r["up"]
            while up in of and not of[up]["valid"]:
                up = of[up]["up"]
            out[r["token"]] = up
    return out


def _surely(on: int, pages: int, z: float = 1.645) -> float:
    """Lower bound of the share of a host's pages that have a text (Wilson's, one-sided at 95%)."""
    p, q = on / pages, z * z / pages
    return (p + q / 2 - (q * (p * (1 - p) + q / 4)) ** 0.5) / (1 + q)


def deduce(rows: list[dict], most_text: float, repeated: float, most_repeated: float) -> Template:
    """The template of one host from its frequent tokens (dicts of token, up, on, times, chars, linked, flags, place, pages,
    valid)."""
    nests, of = nest(rows), {r["token"]: r for r in rows if r["valid"]}
    own = lambda t: of[t]["chars"] - of[t]["linked"]
    above = lambda t: [t, *above(nests[t])] if t in nests else []
    once = [t for t, r in of.items() if r["times"] == r["on"] and not r["flags"] & (TEXT | HARD | WEAK)]
    if not once or ROOT not in of or own(ROOT) <= 0:
        return Template()
    full = [t for t in once if own(t) >= most_text * own(ROOT)]
    slot = min(full, key=lambda t: (own(t), -of[t]["place"]))  # the innermost: of disjoint elements only one can hold so much
    tagged = [t for t in above(slot) if of[t]["flags"] & IS_MAIN]
    if tagged:
        slot = tagged[0]
    else:
        headed = lambda t: any(of[h]["flags"] & HEADING and nests[h] == nests[t] and of[h]["place"] < of[t]["place"] for h in once)
        while (of[slot]["flags"] & LEVEL or headed(slot)) and nests[slot] in of and not of[nests[slot]]["flags"] & WHOLE:
            slot = nests[slot]
        if of[slot]["flags"] & (WHOLE | LEVEL):
            slot = nests[slot] if of[slot]["flags"] & LEVEL and nests[slot] in of else slot
            main = [t for t in once if of[t]["flags"] & IS_MAIN and own(t) > 0]
            slot = main[0] if len(main) == 1 else slot
    outside = set(above(slot))
    inside = {t for t in of if t not in outside and slot in above(t)}
    pages = of[ROOT]["pages"]
    said = [t for t in inside if of[t]["flags"] & TEXT and not of[t]["flags"] & HARD and _surely(of[t]["on"], pages) >= repeated]
    if sum(of[t]["chars"] for t in said) > most_repeated * own(slot):
        said = []  # copies of an article, not a template
    dense = lambda r: r["chars"] > 0 and 2 * r["linked"] >= r["chars"] and not r["flags"] & (LEVEL | HEADING | IS_MAIN | LINK)
    furniture = [t for t in inside if not of[t]["flags"] & TEXT and (of[t]["flags"] & IS_WEAK or dense(of[t]) and of[t]["times"] == of[t]["on"])]
    return Template(slot, frozenset(said), frozenset(furniture))


def templates(
    named: DataFrame, frequent: float = 0.6, most_text: float = 0.6, repeated: float = 0.7, most_repeated: float = 0.3, disorder: float = 0.1, rounds: int = 4,
) -> DataFrame:
    """(host, slot, fixed, furniture, split): the template of each host of two different pages or more.

    named: host, html. Classes on under `frequent` of a host's pages are no template, nor are tokens that break their
    class's order on over `disorder` of their pages. The slot is the innermost element found once a page that holds most_text of the text outside
    furniture and links; from a text-level element, or one with a heading before it, it widens to its parent. A text is the
    template's own, in the slot, if surely (see _surely()) over `repeated` of the pages have it and such texts together are at most
    most_repeated of the slot's: above that they are copies of an article. Paths that occur equally often on
    all but `disorder` of their pages are told apart by place, in `rounds` rounds at most, each reaching a level deeper. A host has no more template tokens than 1 / frequent times those of a page.
    """
    nodes = materialize(skeletons(named), "skeletons")
    different = nodes.select("host", "own").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("host")
    split = different.withColumn("split", F.array().cast("array<long>"))
    left, done = nodes, []
    for r in range(rounds):
        left = _told(left.drop("split"), split, "1 + size(split)", "own").where("split is not null")
        known = materialize(_frequent(occurrences(left), frequent), "tokens")
        steady = (F.col("usual.each") > 1) & (F.col("on") > 1) & (F.col("usual.on") >= F.lit(1 - disorder) * F.col("on"))
        more = known.where(steady & (F.col("flags").bitwiseAND(TEXT) == 0) & (r + 1 < rounds))
        more = materialize(more.groupBy("host").agg(F.collect_set("token").alias("more")), "apart")
        own = materialize(known.join(more, "host", "left_anti"), "tokens-settled")
        settled = left.join(more.select("host"), "host", "left_anti")
        done.append((own, _disordered(settled, own, disorder), split.join(more, "host", "left_anti")))
        if not more.take(1):
            break
        split = materialize(split.join(more, "host").select("host", F.array_union("split", "more").alias("split")), "split")
    known, off, apart = done[0]
    for a, b, c in done[1:]:
        known, off, apart = known.unionByName(a), off.unionByName(b), apart.unionByName(c)
    off = materialize(off.withColumn("valid", F.lit(False)), "disordered")
    valid = known.join(off, ["host", "token"], "left").withColumn("valid", F.coalesce("valid", F.lit(True)))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = deduce(frame.to_dict("records"), most_text, repeated, most_repeated)
        return pd.DataFrame({"host": [key[0]], "slot": pd.array([x.slot], "Int64"), "fixed": [sorted(x.fixed)], "furniture": [sorted(x.furniture)]})

    found = valid.groupBy("host").applyInPandas(run, "host string, slot long, fixed array<long>, furniture array<long>")
    out = materialize(found.join(apart, "host"), "templates")
    drop(nodes)
    return out


def extract(source: str | None, template: Template = Template()) -> str:  # noqa: B008 (frozen sets only)
    """Main text of one page given its host's template; blocks are joined by an empty line.

    A page that has nothing in the template's slot, or whose host has no template, is read by its own structure: what lies
    in its article or main elements, else all beside furniture. A page of furniture alone has no main text.
    """
    page = parse(source or "")
    path, flags = tokens(page.names, page.ups, template.split), page.flags
    inside, apart = [False] * len(path), [False] * len(path)
    for i, t in enumerate(path):
        up = page.ups[i]
        inside[i] = t == template.slot or i > 0 and inside[up]
        apart[i] = t in template.furniture or i > 0 and apart[up]
    good = [i for i in page.texts if not flags[i] & (HARD | WEAK)]
    kept = [i for i in good if inside[i] and not apart[i]]
    if kept and template.slot is not None and any(flags[i] & WHOLE for i, t in enumerate(path) if t == template.slot):
        kept = [i for i in kept if flags[i] & MAIN] or kept
    kept = kept or [i for i in good if flags[i] & MAIN] or good
    return "\n\n".join(page.texts[i] for i in kept if path[i] not in template.fixed)


def main_texts(pages: DataFrame, **options) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html); other columns are ignored.

    Null or empty html, or html without main text, gives an empty text. Pages without a host (null url) form a host of their
    own. A host of one page, or of copies of one, has no template: then only the page's own structure counts. Of elements
    that hold the same text the innermost is the slot. Repeated rows each give a row; an empty table gives an empty result.
    """
    named = parts(pages.select("page_id", "url", "html")).select("host", "page_id", "url", "html")
    found = templates(named, **options)
    told = _told(named, found, "2 + size(fixed) + size(furniture) + size(split)", "page_id", "url")
    kinds = {c: named.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, Template())
        for b in batches:
            texts = []
            hosts, sources, slots, *sets = b.columns[2:]
            for i, host in enumerate(hosts.to_pylist()):
                if last[0] != host:
                    last = (host, Template(slots[i].as_py(), *(frozenset(x[i].as_py() or ()) for x in sets)))
                texts.append(extract(sources[i].as_py(), last[1]))
            out = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], ["page_id", "url", "text", "n_chars"])

    told = long_rows(told.select("page_id", "url", "host", "html", "slot", "fixed", "furniture", "split"))
    return told.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op4_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of pages; see main_texts()."""
    return main_texts(table(spark, sf_dir, "pages"))
