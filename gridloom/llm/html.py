"""Main text of web pages: site templates found by counting, and fixed rules for what is never an article.

Each page is parsed once into text blocks; a block knows the hashes of the elements around it. A subtree's hash covers
its tags, its text and its host. Spark counts on how many different pages of a host each subtree occurs; one that recurs
on many is a template, and its blocks go: menus, notices, adverts, headers and footers alike. Pages with the same article
count as one page, so copies of an article never look like a template. Elements inside ``article`` and ``main`` are
counted only where they are containers, so a sentence that many articles share stays. What is never part of an article
(the elements in ``NEVER``; whole class and id tokens that name such parts) goes without counting, for it need not recur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A subtree on at least so many different pages of a host is a template, however large the host.
MIN_PAGES = 5
#: At most so many template hashes (8 bytes each) are sent to the tasks as one array; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("div section ul ol dl table figure details center menu fieldset nav header footer aside form".split())
#: Counted outside articles only.
COUNTED = frozenset("p li dt dd tr td h1 h2 h3 h4 h5 h6 blockquote pre address span a button label".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input map menu meter nav noembed noframes noscript object "
    "progress script search select style svg template textarea title video xmp".split()
)
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Class and id tokens, cut at "-" and "_": a token counts if it has a name and, beside names, nothing but places and parts.
_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe "
    "signup sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments "
    "commentlist respond replies disqus share sharing social related recommended popup modal overlay toolbar pagination widget".split()
)
_AFFIXES = frozenset(
    "site page top main global left right bottom primary secondary post posts entry article articles user reader header inner outer mobile desktop sticky fixed "
    "floating inline area section list item items box bar block wrap wrapper container panel button buttons btn link links icon icons title text form message thread slot unit "
    "google small large side skip".split()
)
_HEADERS = re.compile(r"(?i)(?:^|\s)(?:(?:site|page|top|global|main)[_-]?)?header(?:$|\s)")
_ROLES = re.compile(r"(?i)^(?:navigation|banner|contentinfo|complementary|search|form|alert|dialog|menu|menubar|toolbar)$")
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


def _names(value: str) -> bool:
    """A whole token of a class or id names what is never an article; ``no-sidebar`` or ``social-science`` do not."""
    for token in value.lower().split():
        parts = [x for x in re.split("[-_]+", token) if x and not x.isdigit()]
        if token in ("side-bar", "skip-link") or not _NAMES.isdisjoint(parts) and all(x in _NAMES or x in _AFFIXES for x in parts):
            return True
    return False


def _never(name: str, attrs: str, in_article: int) -> bool:
    """By its tag, role or hidden state this element holds nothing of the article."""
    if name in NEVER or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "main", "h1"):
        return False
    for which, a, b, c in _ATTR.findall(attrs):
        which, value = which.lower(), a or b or c
        if which == "hidden" or (which == "aria-hidden" and value.lower() == "true") or (which == "role" and _ROLES.match(value)):
            return True
    return False


def _named(name: str, attrs: str, in_article: int) -> bool:
    """Its class or id names a part that is no article. Such an element goes unless it holds most of the text of a page
    without an article elsewhere."""
    if not attrs or name in ("html", "body", "main", "article", "h1"):
        return False
    return any(w.lower() in ("class", "id") and (_names(v := a or b or c) or (not in_article and bool(_HEADERS.search(v)))) for w, a, b, c in _ATTR.findall(attrs))


def blocks(page: str, host: str = "") -> list[tuple[str, list[int], bool, bool]]:
    """Text blocks in page order: text, hashes of the counted elements around it (outermost first), whether a rule drops
    it, and whether it lies in an ``article`` or ``main`` element.

    White space inside a block is one space; ``br`` counts as white space. Elements inside a block that a rule drops (a
    button, a hidden span) leave no block behind.
    """
    found: list[list] = []  # [text, frames, in article, dropped, named elements]
    stack: list[list] = []  # [name, hasher, drops, hash slot, is article, place of a named element, mutes]
    words: list[str] = []
    skip = article = mute = 0
    root = xxhash.xxh64()
    salt = xxhash.xxh64_intdigest(host)
    named: list[int] = []  # characters inside each named element

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                inside = [f[5] for f in stack if f[5] is not None]
                found.append([text, [f[3] for f in stack if f[3] is not None], article > 0, skip > 0, inside])
                if not skip:
                    for k in inside:
                        named[k] += len(text)

    def close() -> None:
        nonlocal skip, article, mute
        name, hasher, drops, slot, main, _, mutes = stack.pop()
        mute -= mutes
        skip -= drops
        article -= main
        digest = hasher.digest()
        if slot is not None:
            slot.append(xxhash.xxh64_intdigest(digest, salt) - 2**63)
        (stack[-1][1] if stack else root).update(digest)

    def take(raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        if text.strip():
            (stack[-1][1] if stack else root).update(text)
        if not mute:
            words.append(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        attrs = m[3] or m[6] or ""
        if m[1] or m[4]:
            open_ = next((f for f in reversed(stack) if f[0] == name), None)
            if name in BLOCK:
                flush()
            if open_:
                while stack[-1] is not open_:
                    close()
                close()
            continue
        if name == "br":
            take(" ")
            continue
        if name in BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        close()
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in CLOSED_BY_SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name or (name in ("dt", "dd") and stack[k][0] in ("dt", "dd")):
                    while len(stack) > k:
                        close()
                    break
                if stack[k][0] in CLOSED_BY_SAME[name]:
                    break
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            (stack[-1][1] if stack else root).update(name)
            continue
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])|\\Z", re.I).search(page, at).start()
            (stack[-1][1] if stack else root).update(name)
            at = stop
            continue
        drops = _never(name, attrs, article)
        place, mutes = None, False
        if not skip and (drops or _named(name, attrs, article)):
            if name not in BLOCK:
                mutes = True  # the block around it stays one block
            elif not drops:
                place = len(named)
                named.append(0)
        main = name in ("article", "main") and not drops
        article += main
        skip += drops
        mute += mutes
        counted = name in CONTAINER or (name in COUNTED and not article)
        stack.append([name, xxhash.xxh64(name), drops, [] if counted else None, main, place, mutes])
    flush()
    while stack:
        close()
    # where an article stands outside of them, named elements hold none, however long they are
    whole = float("inf") if any(f[2] and not f[3] and not f[4] for f in found) else sum(len(f[0]) for f in found if not f[3])
    return [(text, [slot[0] for slot in slots], main, dropped or any(2 * named[k] <= whole for k in inside)) for text, slots, main, dropped, inside in found]


def main_text(found: list[tuple[str, list[int], bool, bool]], gone=frozenset()) -> list[str]:
    """What is left of ``blocks`` without the templates in ``gone``. If articles hold at least half of it, it is theirs
    alone; so a page with one short teaser in an ``article`` keeps its own text."""
    kept = [(text, main) for text, hashes, main, dropped in found if not dropped and gone.isdisjoint(hashes)]
    if 2 * sum(len(t) for t, main in kept if main) >= sum(len(t) for t, _ in kept):
        kept = [x for x in kept if x[1]]
    return [t for t, _ in kept]


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].lower()


_BLOCKS = "blocks array<struct<text:string,hashes:array<long>,main:boolean,dropped:boolean>>"


def parse(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, content (hash of the text that no rule drops) and blocks: array of (text, hashes, main, dropped)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks(h, host_of(u)) for h, u in zip(batch["html"], batch["url"])]
            yield pd.DataFrame({
                "page_id": batch["page_id"].astype("Int64"),
                "url": batch["url"],
                "content": np.array([xxhash.xxh64_intdigest("\n".join(main_text(f))) for f in found], dtype=np.uint64).view(np.int64),
                "blocks": [[{"text": t, "hashes": h, "main": m, "dropped": d} for t, h, m, d in f] for f in found],
            })

    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), common.text_or_empty(page).alias("html"))
    return rows.mapInPandas(run, f"page_id long, url string, content long, {_BLOCKS}")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(hash, count): subtrees that occur on at least ``min_pages`` different pages of their host."""
    around = pages.select("content", F.explode(F.array_distinct(F.flatten(F.col("blocks.hashes")))).alias("hash"))
    return around.distinct().groupBy("hash").count().where(F.col("count") >= min_pages)


def _without(pages: DataFrame, found: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Text of each page without the blocks of templates: ``gone`` gives them by row, else they are looked up in an array."""
    if gone is None:
        held = pages.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in found.select("hash").collect()], dtype=np.int64)))

        @F.pandas_udf("array<long>")
        def known(hashes: pd.Series) -> pd.Series:
            sizes = hashes.map(len).to_numpy()
            flat = np.concatenate([*hashes, np.zeros(0, np.int64)]).astype(np.int64)
            at = np.searchsorted(held.value, flat)
            hit = held.value[np.minimum(at, len(held.value) - 1)] == flat if len(held.value) else np.zeros(len(flat), bool)
            ends = np.cumsum(sizes)
            return pd.Series([flat[e - n : e][hit[e - n : e]] for e, n in zip(ends, sizes)], index=hashes.index, dtype=object)

        joined = pages.withColumn("gone", known(F.flatten(F.col("blocks.hashes"))))
    else:
        joined = pages.join(gone, "row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))
    kept = F.filter("blocks", lambda b: ~b["dropped"] & ~F.arrays_overlap(b["hashes"], F.col("gone")))
    size = lambda column: F.aggregate(F.transform(column, lambda b: F.length(b["text"])), F.lit(0), lambda x, y: x + y)
    kept_rows = joined.withColumn("kept", kept).withColumn("mine", F.filter("kept", lambda b: b["main"]))
    text = F.array_join(F.when(2 * size(F.col("mine")) >= size(F.col("kept")), F.col("mine.text")).otherwise(F.col("kept.text")), "\n")
    return kept_rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """One row per input row: page_id, url, text (blocks joined by line feeds; empty if none), n_chars.

    Null html counts as empty; a null url has the empty host. Repeated rows are told apart by a row number written once.
    Only key, url and html are read.
    """
    pages = common.shared_table(parse(df, key, url, page).withColumn("row", F.monotonically_increasing_id()), "pages")
    found = common.shared_table(templates(pages), "templates")
    if found.count() <= broadcast_hashes:
        return _without(pages, found, None)
    around = pages.select("row", F.explode(F.array_distinct(F.flatten(F.col("blocks.hashes")))).alias("hash"))
    return _without(pages, found, around.join(found, "hash").groupBy("row").agg(F.collect_set("hash").alias("gone")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
