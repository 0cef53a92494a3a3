"""HTML extraction by equivalence-class template deduction.

Every page is read as a sequence of tokens in context: a tag with its path, or a word of a text run with its path (a run
of more than SHORT_RUN words is one token, the run itself); occurrences of one token on a page are told apart by their
count, so each is a token with a role of its own. Over the distinct contents of one host's pages, a token's
occurrence vector says how often each has it. Tokens with one vector form an equivalence class; a vector is represented
by its page count and a 64-bit sum of content hashes times counts, so classes come from plain aggregations with partial
sums and a host that holds a third of all pages is no single group anywhere. A class is valid if it is large and frequent
enough (MIN_TOKENS, MIN_PAGES, MIN_SHARE of the host's contents) and holds markup; copies of a page prove nothing, as
they are one content.

Valid classes are ordered and nested: the tokens of a class stand in the order of their mean places and have gaps between
them; from the most frequent and largest class on, each one goes into the deepest gap that
holds all its places, and one that straddles a token of its parent is not valid. The tree is the host's template.

A page is split at the template's tokens. A text run is template if its words are a stretch of one class, in its order;
all else are slots, which are extracted in page order. Elements by role only assist: the text of an `article` is never
taken for template, slots in navigation, header, footer, aside, form, script and the like, or below elements whose
class, id or role says so, are left out, and the slots of the article go before those of the main element and the body.
Hosts with too few contents have no template; there the slots are all text.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by a newline.
A line break element counts as white space. Unclosed elements end where their parent or the next block ends; an article
that opens inside an unclosed notice ends the notice.

Defined results: null or empty html has the text "" and 0 characters; a null url has no host and so no template; html
without markup is one block; repeated rows give repeated results; classes that tie in frequency and size nest in the
order of their first places, then of their tokens; a page of any length is read whole; an empty table gives an empty
result; other columns pass by unread.
"""

from __future__ import annotations

import bisect
import html as _html
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, bitmap_table, maybe_in, surely_not_in
from .op1_urlfilter import host_of

MIN_PAGES, MIN_TOKENS, MIN_SHARE, SHORT_RUN = 5, 3, 0.5, 16
#: A host with more than this share of the pages is dealt over SALTS tasks.
HOT, SALTS = 0.001, 64
BITS = 1 << 25

# Elements and names by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head title nav footer aside form button select textarea script style noscript template iframe object svg canvas audio video dialog menu map".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget widgets footer foot masthead topbar toolbar share sharing social related recommended newsletter "
    "subscribe signup login search comment comments reply replies disqus respond discussion pagination pager skip copyright".split()
)
CLOSES_P = BLOCKS - {"html", "body"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|template)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.S)


def _attributes(raw: str) -> dict[str, str]:
    if not raw or "=" not in raw and "hidden" not in raw:
        return {}
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


def _boilerplate(name: str, attr: dict[str, str], in_article: bool) -> bool:
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    if not attr:
        return False
    if attr.get("role", "").lower() in ROLES or "hidden" in attr or re.search(r"display\s*:\s*none", attr.get("style", "")):
        return True
    if name in ("html", "body", "article", "main"):
        words = set(attr.get("class", "").lower().split()) | set(attr.get("id", "").lower().split())
        return name == "article" and bool(words & {"comment", "ad", "advert", "promo", "related", "reply"})
    words = set(re.split(r"[\s_-]+", f"{attr.get('class', '')} {attr.get('id', '')}".lower()))
    return bool(words & NAMES) or not in_article and bool(words & {"header", "head"})


def read(page: str):
    """Runs of one page in order, paths as hashes: ("tag", path) and ("text", path, text, place, block), where place is 0 for
    boilerplate, 1 for the body, 2 for the main element and 3 for the article. Runs with one block number are one
    block."""
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 1)]  # name, path, left out, place
    block = at = 0

    def text(raw: str):
        if raw and not raw.isspace():
            name, path, out, place = stack[-1]
            yield "text", path, raw, 0 if out else place, block

    for m in _TOKEN.finditer(page):
        yield from text(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                yield "tag", _hash("in", stack[-1][1], m[1].lower())
            continue
        if m[2]:
            if name in BLOCKS:
                block += 1
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    yield "tag", _hash("end", stack[i][1])
                    del stack[i:]
                    break
            continue
        if name == "br":
            yield "text", stack[-1][1], " ", 0 if stack[-1][2] else stack[-1][3], block
            continue
        if name in BLOCKS:
            block += 1
            if name in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCKS:
                        break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SAME_LEVEL.get(name, ()):
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "table", "dl", "select"):
                    break
        attr = _attributes(m[4])
        own, path, out, place = stack[-1]
        bad = _boilerplate(name, attr, place == 3)
        if name == "article":
            out, place = bad, 3
        elif name == "main" or attr.get("role") == "main":
            out, place = False, max(place, 2)
        elif bad:
            out = True
        label = f"{name}.{attr['class']}" if attr.get("class") else name
        path = _hash("in", path, label)
        yield "tag", path
        if name not in VOID and not m[4].endswith("/"):
            stack.append((name, path, out, place))
    yield from text(page[at:])


def _hash(kind: str, path: int, word: str = "") -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{word}".encode("utf-8", "surrogatepass"))


def tokens_of(path: int, raw: str) -> list[int]:
    """The tokens of a text run."""
    words = raw.split()
    return [_hash("word", path, w) for w in words] if len(words) <= SHORT_RUN else [_hash("run", path, " ".join(words))]


class Roles:
    """Tells a token's occurrences on one page apart by their count."""

    def __init__(self):
        self.had: dict[int, int] = {}

    def __call__(self, token: int) -> int:
        n = self.had[token] = self.had.get(token, -1) + 1
        return (token + n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def occurrences(page: str) -> dict[int, tuple[int, float, bool]]:
    """token -> (how often, first place, whether it is markup). Places count tags and runs."""
    out: dict[int, list] = {}
    role = Roles()
    for i, x in enumerate(read(page)):
        if x[0] == "tag":
            out.setdefault(role(x[1]), [0, float(i), True])[0] += 1
        else:
            tokens = tokens_of(x[1], x[2])
            for j, t in enumerate(tokens):
                out.setdefault(role(t), [0, i + j / len(tokens), False])[0] += 1
    return {t: tuple(v) for t, v in out.items()}


def _occurrence_table(pages: DataFrame) -> DataFrame:
    """Partial sums by (host, token): vector, pages, times, place, markup."""
    import pyarrow as pa

    fields = "host string, token long, vector long, pages long, times long, place double, markup int"
    names = ["host", "token", "vector", "pages", "times", "place", "markup"]

    def flush(sums):
        cols = list(zip(*[(h, t, *v) for (h, t), v in sums.items()])) or [()] * 7
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
        cols[1:3] = [np.array(c, np.uint64).view(np.int64) for c in cols[1:3]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def run(batches):
        sums: dict = {}
        mask = (1 << 64) - 1
        for b in batches:
            for key, host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for t, (n, place, markup) in occurrences(page.as_py() or "").items():
                    v = sums.setdefault((host, t), [0, 0, 0, 0.0, int(markup)])
                    v[0] = (v[0] + (key & mask) * n) & mask
                    v[1] += 1
                    v[2] += n
                    v[3] += place
                if len(sums) > 300_000:
                    yield flush(sums)
                    sums = {}
        if sums:
            yield flush(sums)

    return pages.mapInArrow(run, fields)


def nest(classes: list[tuple[int, list[tuple[float, int]]]]) -> dict[int, tuple[int, int]]:
    """token -> (class, index in the class's order) of the classes that nest. classes: (pages, [(place, token)])."""
    order = sorted((-pages, -len(members), sorted(members)) for pages, members in classes)
    places: list[list[float]] = []
    inner: dict[int, list[int]] = defaultdict(list)  # -1: the page itself
    out: dict[int, tuple[int, int]] = {}
    for _, _, members in order:
        lo, hi = members[0][0], members[-1][0]
        home, fits = -1, True
        while fits:  # down the gaps that hold the whole class
            near = next((c for c in inner[home] if lo <= places[c][-1] and hi >= places[c][0]), None)
            if near is None:
                break
            before = bisect.bisect_right(places[near], lo)
            fits = before > 0 and before == bisect.bisect_left(places[near], hi)
            home = near
        if fits:
            inner[home].append(len(places))
            out.update({t: (len(places), i) for i, (_, t) in enumerate(members)})
            places.append([p for p, _ in members])
    return out


def templates(pages: DataFrame, stash: Stash) -> DataFrame:
    """One row per host with a template: host, tokens (token, class, index in the class's order)."""
    import pyarrow as pa

    keyed = pages.where("host <> ''").select(F.xxhash64("host", "html").alias("key"), "host", "html")
    marks = stash.put(bitmap_table(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", BITS), "copies")
    # One page of each content: only those that may have copies are shuffled.
    contents = surely_not_in(keyed, "key", marks, BITS).unionByName(maybe_in(keyed, "key", marks, BITS).dropDuplicates(["key"])).select("key", "host", "html")
    # Long addition wraps in hexadecimal halves, so that sums can't overflow.
    seen = _occurrence_table(contents).groupBy("host", "token").agg(
        F.sum(F.col("vector").bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned("vector", 32)).alias("high"),
        F.sum("pages").alias("pages"), F.sum("times").alias("times"), (F.sum("place") / F.sum("pages")).alias("place"), F.max("markup").alias("markup"),
    )
    sizes = keyed.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("all_pages")).where(F.col("all_pages") >= MIN_PAGES)
    often = stash.put(seen.join(sizes, "host").where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("all_pages")) & (F.col("times") == F.col("pages"))).drop("all_pages", "times"), "often")
    same = ["host", "low", "high", "pages"]
    valid = often.groupBy(*same).agg(F.count("*").alias("size"), F.max("markup").alias("markup")).where((F.col("size") >= MIN_TOKENS) & (F.col("markup") == 1))
    members = often.join(valid.select(*same), same, "left_semi").select(*same, "place", "token")

    def tree(key, t):
        """A host's classes have at most its pages' mean number of tokens, over MIN_SHARE, in all."""
        classes: dict = defaultdict(list)
        for low, high, pages, place, token in zip(*(t.column(c).to_pylist() for c in ("low", "high", "pages", "place", "token"))):
            classes[low, high, pages].append((place, token))
        got = nest([(k[2], v) for k, v in classes.items()])
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([[{"token": k, "class": c, "index": i} for k, (c, i) in got.items()]], pa.list_(pa.struct([("token", pa.int64()), ("class", pa.int32()), ("index", pa.int32())])))], ["host", "tokens"])

    return members.groupBy("host").applyInArrow(tree, "host string, tokens array<struct<token: long, class: int, index: int>>")


class Walk:
    """Follows a page through its host's template."""

    def __init__(self, template: dict[int, tuple[int, int]]):
        self.template, self.role = template, Roles()
        self.last: dict[int, int] = {}  # class -> index of the token met last

    def tag(self, path: int) -> None:
        if at := self.template.get(self.role(path)):
            self.last[at[0]] = max(at[1], self.last.get(at[0], -1))

    def covers(self, tokens: list[int]) -> bool:
        """Whether a run is template: a stretch of one class, in its order and after what has been met of it."""
        at = [self.template.get(self.role(t)) for t in tokens]
        if not at or None in at or any(b[0] != a[0] or b[1] != a[1] + 1 for a, b in zip(at, at[1:])) or at[0][1] <= self.last.get(at[0][0], -1):
            return False
        self.last[at[0][0]] = at[-1][1]
        return True


def main_text(page: str, template: dict[int, tuple[int, int]] | None = None) -> str:
    """The main text of one page."""
    runs: list[tuple[int, int, str]] = []
    best = 0
    walk = Walk(template) if template else None
    for x in read(page):
        if x[0] == "tag":
            if walk:
                walk.tag(x[1])
            continue
        _, path, raw, place, block = x
        covered = walk is not None and walk.covers(tokens_of(path, raw))
        if not place or covered and place < 3:
            continue
        if raw != " " or runs:
            runs.append((place, block, raw))
        if not raw.isspace():
            best = max(best, place)
    blocks: dict[int, list[str]] = defaultdict(list)
    for place, block, raw in runs:
        if place == best:
            blocks[block].append(raw)
    lines = (" ".join(_html.unescape("".join(b)).split()) for _, b in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, stash: Stash, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    import pyarrow as pa

    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    id_type = dict(own.dtypes)["id"]
    # Written, the table of templates has a known size: Spark broadcasts it if it is small and sorts both sides if not.
    # Then pages of hosts that have more than a thousandth of all (a thousand hosts at most) are dealt by a salt.
    known_hosts = stash.put(templates(own, stash), "templates")
    sizes = own.groupBy("host").agg(F.count("*").alias("n"))
    least = (sizes.agg(F.sum("n")).first()[0] or 0) * HOT
    hot = [r["host"] for r in sizes.where((F.col("n") > least) & (F.col("n") > 10_000)).select("host").collect()]
    salt = F.when(F.col("host").isin(*hot), F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).otherwise(0) if hot else F.lit(0)
    of_host = F.explode(F.when(F.col("host").isin(*hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))) if hot else F.lit(0)
    joined = own.withColumn("salt", salt).join(known_hosts.withColumn("salt", of_host), ["host", "salt"], "left").select("id", "url", "html", "host", "tokens")

    def run(batches):
        known: dict[str, dict] = {}
        for b in batches:
            texts = []
            tokens = b.column(4)
            for i, (page, host) in enumerate(zip(b.column(2), b.column(3).to_pylist())):
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[host] = {t["token"] & ((1 << 64) - 1): (t["class"], t["index"]) for t in tokens[i].as_py() or ()}
                texts.append(main_text(page.as_py() or "", known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long")
