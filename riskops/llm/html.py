"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its elements, each told apart by its path (tags, classes and ids
with digits masked). A token's occurrence vector over the pages of its host is how often it
occurs on each; tokens with one vector form an equivalence class. The classes that half of a
host's pages hold make up its template; those whose tokens occur once on a page are its frame,
in which the others nest by their paths. What lies between is slots. The article's slot
belongs to the innermost frame token that still holds most of the text outside menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, and a
page's text is what that token holds, less those. Pages without that token take the same
decision from their own tokens alone.

The words of the text are tokens too, told apart by the path they stand in. Of a class of
``CLASS_TOKENS`` or more, the tokens whose place in the class is the same on each page are in
one order on each page; a class other than the host's largest must stand in one gap of that.
Words of such classes are the template's, and what is left in the slot is a page's text.
Hosts of fewer than ``TEXT_PAGES`` different pages show too little to take words for the
template's: they keep all words. The name lists below come first, whatever the classes are.

Vectors are exclusive-ors of hashes of (page, count), so a class costs one combinable
aggregate and no host's pages meet in a task; a template is one row for each host. Places are
least and greatest values, which combine as well.

Defined cases: null or empty html gives an empty text; a null url counts as a host of its own;
equal pages of a host are one page to its template, and each row has its text; an empty table gives an empty result; other columns
are ignored. Unclosed comments and raw-text elements reach to the end, unclosed elements to
their parent's end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written

#: Share of a host's pages that a template token is on, and of the text that the article's token holds.
SUPPORT, HELD = 0.5, 0.9
#: Tokens of a class whose words are the template's, and different pages of a host that has such classes.
CLASS_TOKENS, TEXT_PAGES = 3, 16
#: Keys of words that a task holds, to look up those it has met.
KNOWN_KEYS = 100_000
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"\S+")
# Element names and naming habits of the web (fixed values).
NO_WORD = Counter([""])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template svg iframe select math object".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
CHROME = frozenset("head nav header footer aside form script style title textarea noscript template svg iframe select button menu dialog math object".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead "
    "menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted related respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe toolbar topbar widget widgets complementary contentinfo alert".split()
)
CONTENT = frozenset("html body main article".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@lru_cache(4096)
def named(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's token, and whether it is one of those that hold no article text."""
    names = [v for m in ATTRIBUTE.finditer(attributes) for v in (m[2] or m[3] or m[4] or "").split()] if "=" in attributes else []
    chrome = tag in CHROME or tag not in CONTENT and any(w in CHROME_NAMES for n in names for w in re.split(r"[^a-z]+", n.lower()))
    return ".".join([tag, *sorted(re.sub(r"\d+", "0", n) for n in names)]), chrome


def elements(html: str) -> tuple[list[str], list[tuple[str, int, str, int]]]:
    """Paths of all elements in page order, and the (path, block, text, elements before) nodes outside chrome."""
    paths: list[str] = []
    nodes: list[tuple[str, int, str, int]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, path, in chrome
    at = block = 0

    def pop(tag: str, stop: frozenset | set) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return True
            if stack[k][0] in stop:
                return False
        return False

    def text(upto: int) -> None:
        if upto > at and not (stack and stack[-1][2]) and not html.isspace():
            nodes.append((stack[-1][1] if stack else "", block, html[at:upto], len(paths)))

    m = MARKUP.search(html)
    while m:
        text(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            m = MARKUP.search(html, at)
            continue
        if tag not in INLINE:
            block += 1
        if tag == "br":
            nodes.append((stack[-1][1] if stack else "", block, " ", len(paths)))
        if m[1]:
            pop(tag, {"article", "body", "html"} if tag in INLINE or tag == "p" else frozenset())
        else:
            if tag not in INLINE:
                pop("p", {"article", "section", "div", "td", "li", "blockquote", "body", "table"})
            for t in CLOSES.get(tag, ()):
                pop(t, {"ul", "ol", "dl", "table", "select"})
            token, chrome = named(tag, m[3])
            path, inside = (stack[-1][1], stack[-1][2]) if stack else ("", False)
            path = f"{path}/{token}"
            paths.append(path)
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append((tag, path, inside or chrome))
        m = MARKUP.search(html, at)
    text(len(html))
    return paths, nodes


def ancestors(path: str) -> list[str]:
    cuts = [k for k, c in enumerate(path) if c == "/"][1:]
    return [path[:k] for k in cuts] + [path] if path else []


def own_tokens(html: str) -> dict[str, tuple[int, int]]:
    """For each token of a page how often it occurs and how many characters of text it holds."""
    return tokens_of(*elements(html))


def tokens_of(paths: list[str], nodes: list[tuple[str, int, str, int]]) -> dict[str, tuple[int, int]]:
    count, own, held = Counter(paths), Counter(), Counter()
    for path, _, text, _ in nodes:
        own[path] += len(text.strip())
    for path, size in own.items():
        for a in ancestors(path):
            held[a] += size
    return {p: (n, held[p]) for p, n in count.items()} | {"": (1, sum(own.values()))}


def key(path: str, word: str = "") -> int:
    """A number for an element's token, or for that of a word in it."""
    # 48 bits are enough within a host and make shorter shuffle files; the low zeros join those before them
    return int.from_bytes(b"\0\0" + blake2b(f"{path}\t{word}".encode("utf-8", "replace"), digest_size=6).digest(), "little", signed=True)


def words_of(nodes: list[tuple[str, int, str, int]]) -> dict[str, Counter]:
    """How often each word occurs in each path outside chrome."""
    found: dict[str, Counter] = {}
    for path, _, text, _ in nodes:
        words = text.split()
        if words:
            found.setdefault(path, Counter()).update(words)
    return found


class Keys:
    """Keys by path and word, each computed once while they are held."""

    def __init__(self):
        self.known: dict[str, dict[str, int]] = {}
        self.held = 0

    def of(self, path: str, words: Counter) -> Iterator[int]:
        if self.held > KNOWN_KEYS:
            self.known, self.held = {}, 0
        known = self.known.setdefault(path, {})
        new = [w for w in words if w not in known]
        known.update((w, key(path, w)) for w in new)
        self.held += len(new)
        return map(known.__getitem__, words)


def sequence(paths: list[str], nodes: list[tuple[str, int, str, int]]) -> Iterator[tuple[str, str]]:
    """(path, word) of all tokens in page order; an element has an empty word."""
    at = 0
    for path, _, text, before in nodes:
        for p in paths[at:before]:
            yield p, ""
        at = before
        for w in text.split():
            yield path, w
    for p in paths[at:]:
        yield p, ""


def places(html: str, class_of: dict[int, tuple[int, int]], known: dict[tuple[str, str], int]) -> Iterator[tuple[int, int, int]]:
    """(key, place in its class, tokens of class 0 before) of each token of a class; ``class_of`` has class and size."""
    seen: Counter = Counter()
    for token in sequence(*elements(html)):
        k = known.get(token)
        if k is None:
            k = known[token] = key(*token)
        if k in class_of:
            c, size = class_of[k]
            yield k, seen[c] % size, seen[0] if c else 0
            seen[c] += 1


def main_text(html: str, slot: str | None, dropped: frozenset[int] = frozenset()) -> str:
    """The blocks inside ``slot``, or, where the page lacks it, inside the token that its own counts choose, without ``dropped`` words."""
    paths, nodes = elements(html)
    if slot is None or slot and slot not in paths:
        tokens = tokens_of(paths, nodes)
        enough = [p for p, (n, size) in tokens.items() if n == 1 and size >= HELD * tokens[""][1]]
        slot = max(enough, key=lambda p: (p.count("/"), p))
    blocks: dict[int, list[str]] = {}
    for path, block, text, _ in nodes:
        if dropped:
            text = WORD.sub(lambda m: "" if key(path, m[0]) in dropped else m[0], text)  # noqa: B023
        if not slot or path == slot or path.startswith(slot + "/"):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def hosts(pages: DataFrame) -> DataFrame:
    """page_id, url, html and host."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(host, F.lit("~")).alias("host"))


def different(pages: DataFrame) -> DataFrame:
    """host, page, html: equal pages of a host once (more often only where they share their page_id)."""
    pages = pages.select("host", F.xxhash64("html").alias("page"), F.xxhash64("page_id").alias("row"), "html")
    again = pages.groupBy("host", "page").agg(F.min("row").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pages.join(written(again, "equal_pages"), ["host", "page"], "left").where("kept is null or kept = row").select("host", "page", "html")


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """host, slot, dropped: the frame token that holds a host's articles, the keys of the template's words."""
    pages = different(pages)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        keys = Keys()
        for part in slices(batches, 64):
            out: list[list] = [[], [], [], [], [], []]
            for host, page, html in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html"))):
                paths, nodes = elements(html)
                own, words = tokens_of(paths, nodes), words_of(nodes)
                out[2] += own
                out[3] += [k for p in own for k in keys.of(p, NO_WORD)]
                out[4] += [n for n, _ in own.values()]
                out[5] += [h for _, h in own.values()]
                for path, count in words.items():
                    out[3] += keys.of(path, count)
                    out[4] += count.values()
                many = len(out[3]) - len(out[0])
                out[0] += [host] * many
                out[1] += [page] * many
                out[2] += [None] * (many - len(own))
                out[5] += [0] * (many - len(own))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["host", "page", "token", "key", "n", "held"])

    found = pages.mapInArrow(tokens, "host string, page long, token string, key long, n long, held long")
    vectors = found.groupBy("host", "token", "key").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("pages"), F.max("n").alias("most"), F.sum("held").alias("held")
    )
    vectors = written(vectors.where(F.col("token").isNotNull() | (F.col("pages") >= support * TEXT_PAGES)), "vectors")
    whole = vectors.where("token = ''").select("host", F.col("pages").alias("all_pages"), F.col("held").alias("all_held"))
    large = vectors.where("token is null or token != ''").join(whole, "host").where(F.col("pages") >= support * F.col("all_pages"))
    large = large.where(F.col("token").isNotNull() | (F.col("all_pages") >= TEXT_PAGES))
    # a class: the tokens with one vector; each page has so many large ones at most, so a host's list is short
    classes = written(large.groupBy("host", "vector", "pages", "most", "all_held").agg(F.collect_list(F.struct("token", "key", "held")).alias("tokens")), "classes")
    frame = classes.where("most = 1").select("host", "all_held", F.explode("tokens").alias("t")).where(F.col("t.held") >= HELD * F.col("all_held"))
    depth = F.size(F.split("t.token", "/"))
    slots = frame.groupBy("host").agg(F.max_by("t.token", F.struct(depth, "t.token")).alias("slot"))
    return written(slots.join(template_words(pages, classes), "host", "full"), "templates")


def template_words(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """host, dropped: keys of the words in classes that keep their order, and their gap of the largest, on each page."""
    worded = classes.where(F.size("tokens") >= CLASS_TOKENS).where(F.exists("tokens", lambda t: t.token.isNull()))
    # the host's list of classes, the one on most pages, then of most tokens first
    lists = worded.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.col("pages"), F.size("tokens").alias("size"), "vector", F.col("tokens.key").alias("keys"))), False).alias("classes"))
    lists = written(lists.select("host", F.col("classes.keys").alias("classes")), "class_lists")
    joined = pages.join(lists, "host").select("host", "html", "classes")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of: dict[str, dict[int, tuple[int, int]]] = {}
        for part in slices(batches):
            known: dict[tuple[str, str], int] = {}
            least: dict[tuple[str, int], list[int]] = {}
            for k, (host, html) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist())):
                if host not in class_of:
                    if len(class_of) > 64:
                        class_of.clear()
                    class_of[host] = {x: (c, len(keys)) for c, keys in enumerate(part.column("classes")[k].as_py()) for x in keys}
                for x, place, gap in places(html, class_of[host], known):
                    m = least.setdefault((host, x), [place, place, gap, gap])
                    m[:] = min(m[0], place), max(m[1], place), min(m[2], gap), max(m[3], gap)
            cols = [[h for h, _ in least], [x for _, x in least], *map(list, zip(*least.values()))] if least else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if j else pa.string()) for j, c in enumerate(cols)], ["host", "key", "p0", "p1", "g0", "g1"])

    seen = joined.mapInArrow(placed, "host string, key long, p0 long, p1 long, g0 long, g1 long")
    kept = seen.groupBy("host", "key").agg(F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.min("g0").alias("g0"), F.max("g1").alias("g1"))
    tokens = worded.select("host", "vector", "pages", "most", F.explode("tokens").alias("t")).select("host", "vector", "pages", "most", "t.token", "t.key").join(kept, ["host", "key"])
    right = tokens.groupBy("host", "vector", "pages", "most").agg(
        F.min("g0").alias("g0"), F.max("g1").alias("g1"), F.count_if(F.col("p0") == F.col("p1")).alias("size"),
        F.collect_list(F.when(F.col("token").isNull() & (F.col("p0") == F.col("p1")), F.col("key"))).alias("keys"),
    ).where((F.col("g0") == F.col("g1")) & (F.col("size") >= CLASS_TOKENS))
    return right.groupBy("host").agg(F.flatten(F.collect_list("keys")).alias("dropped"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    pages = hosts(pages)
    joined = pages.join(templates(pages), "host", "left").select("page_id", "url", "html", "host", "slot", "dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, frozenset[int]] = {}
        for part in slices(batches):
            texts = []
            for k, (html, host, slot) in enumerate(zip(*(part.column(c).to_pylist() for c in ("html", "host", "slot")))):
                if host not in words:
                    if len(words) > 64:
                        words.clear()
                    words[host] = frozenset(part.column("dropped")[k].as_py() or ())
                texts.append(main_text(html, slot, words[host]))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([*joined.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(run, schema)
