"""Main text of web pages by a site style tree.

Pages are parsed tolerantly (unclosed and implied end tags, raw-text elements, comments). An element's place in the tree
is its host and the path of tags, classes and ids down to it; the DOMs of a host are merged by adding up, for each place,
how often each presentation style (the kinds of its children) and each content (text of a block) occurs. Importance:
- presentation: the entropy of a place's styles over its pages, to the base of their number;
- content: one less the mean entropy of its blocks' texts over pages; a text on every page counts 0, one on a single
  page 1;
- composite: of the place's own presentation and of all contents below it.
Contents are compared without the host's own name. A host's importance is smoothed towards the same path's over all hosts,
as far as the host has few pages, and taken against that of its whole pages (a host of copies of one page has no more to
remove than another). Importance decides which branches go (a branch goes whole), within what HTML itself says: head, nav,
footer, aside, form and the like go, article and main stay; so do reader comments and related items go by their names,
since they are new on every page. Other names of classes and ids (menu, banner, content, ...) are hints that count only
while a place has been seen on few pages, up to ``SURE``; odds of exactly 0 keep a branch. What is left is one line for
each block, in page order.

Counts are summed by (host, place, style) and (host, place, text) before the shuffle, so a hot host costs each task a row
for each. The removed places of a host meet its pages as a short list; where a host has more than ``HOST_PLACES``, each
page meets its own places only, with the same result.

Null html counts as empty and has an empty text; a null or odd url has an empty host. Repeated rows count as often as they
occur. An empty table gives an empty result. Extra columns stay, but for the html and ones named ``text``.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, blocks, per_key, table, whole_text, worker, written
from .op9_url_filter import parsed

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: start tag -> open elements that it ends, and the elements at which the search for them stops
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}

#: Log odds that a branch is main text: by HTML's own meaning (KEEP, DROP, PLAIN) and, of places on few pages, by names (HINT).
KEEP, DROP, PLAIN, HINT = 5.0, -5.0, 0.25, 2.0
KEPT_TAGS = {"html", "body", "article", "main"}
DROPPED_TAGS = set("head nav footer aside form dialog button select input svg canvas object audio video menu fieldset".split())
NOISE = set("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer footnav form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
CONTENT = set("article articlebody body content entry main maincontent post postbody story text".split())
#: Names of what is new on every page and yet no main text.
BESIDE = set("comment comments disqus related recommended replies reply respond".split())
#: Pages that the overall importance of a path weighs as; the discount of a place's own style for each style it has.
WEIGHT, GAMMA = 256.0, 0.9
#: How far importance moves the log odds from where, and at most down and up; pages on which it begins to count, and counts in full.
PULL, MIDDLE, DOWN, UP = 16.0, 0.75, -4.0, 0.5
UNSURE, SURE = 16, 256
#: Removed places of a host that its pages may carry as one list.
HOST_PLACES = 1_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: The place that all of a page is below.
ROOT = -(1 << 63)


class Element:
    __slots__ = ("tag", "path", "node", "meaning", "hint", "inside")

    def __init__(self, tag: str, path: str, node: int, meaning: float, hint: float, inside: bool):
        self.tag, self.path, self.node, self.meaning, self.hint, self.inside = tag, path, node, meaning, hint, inside


class Parser:
    """Places and blocks of pages. Remembers hashes of paths within a bound."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    def _id(self, path: str) -> int:
        import xxhash

        if len(self.ids) > 100_000:
            self.ids.clear()
        if path not in self.ids:
            self.ids[path] = xxhash.xxh64_intdigest(path) - (1 << 63)
        return self.ids[path]

    def _element(self, tag: str, attributes: str, parent: Element) -> Element:
        names, hidden = [], False
        if attributes.strip():
            for m in _ATTR.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id", "role", "itemprop"):
                    names += _WORD.findall(html_.unescape(value))
                hidden |= key == "hidden" or (key == "style" and bool(_HIDDEN.search(value))) or (key == "aria-hidden" and value.lower() == "true")
        words = {w.lower() for w in names}
        inside = parent.inside or tag in ("article", "main")
        meaning, hint = PLAIN, 0.0
        if hidden or tag in DROPPED_TAGS or (words & BESIDE and not words & CONTENT) or (tag == "header" and not parent.inside):
            meaning = DROP
        elif tag in KEPT_TAGS and not (tag == "article" and words & NOISE):
            meaning = KEEP
        elif words & NOISE and not (tag == "header" and parent.inside):
            hint = -HINT if not words & CONTENT else -HINT / 2
        elif words & CONTENT:
            hint, inside = HINT, True
        path = f"{parent.path}/{tag}" + "".join(f".{w}" for w in sorted(words))
        if hidden:
            path += ".(hidden)"
        if len(path) > 400:  # deep pages: what is above is folded into a number
            path = f"{self._id(path)}"
        return Element(tag, path, self._id(path), meaning, hint, inside)

    def parse(self, html: str) -> tuple[dict[int, tuple[int, float, float]], list[tuple[list[int], str]]]:
        """place -> (style, meaning, hint); blocks: the places down to it, text."""
        root = Element("", "", ROOT, KEEP, 0.0, False)
        stack, at, text = [root], 0, []
        kinds: dict[int, tuple[float, float, set[str]]] = {root.node: (KEEP, 0.0, set())}
        found: list[tuple[list[int], str, bool, list[Element]]] = []

        def flush():
            if text:
                line = " ".join("".join(text).split())
                text.clear()
                if line:
                    found.append(([e.node for e in stack], line, stack[-1].inside, stack[:]))

        size = len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            piece = html[at : m.start() if m else size]
            if piece:
                text.append(html_.unescape(piece) if "&" in piece else piece)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in INLINE:
                if tag in ("br", "img", "wbr"):
                    text.append(" " if tag == "br" else "")
                continue
            if m[1]:
                if any(e.tag == tag for e in stack):
                    flush()
                    while stack.pop().tag != tag:
                        pass
                elif tag in CLOSES_P:
                    flush()
                continue
            flush()
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if tag in VOID:
                continue
            if tag in CLOSES_P and any(e.tag == "p" for e in stack):
                while stack.pop().tag != "p":
                    pass
            if tag in IMPLIED:
                ends, stops = IMPLIED[tag]
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends | stops), 0)
                if depth and stack[depth].tag in ends:
                    first = depth
                    while first > 1 and stack[first - 1].tag in ends:
                        first -= 1
                    del stack[first:]
            if tag in ("html", "body") and any(e.tag == tag for e in stack):
                continue
            element = self._element(tag, m[3], stack[-1])
            kinds[stack[-1].node][2].add(element.path)
            kinds.setdefault(element.node, (element.meaning, element.hint, set()))
            stack.append(element)
        flush()
        if any(inside for _, _, inside, _ in found):  # with an article, plain branches beside it are hardly main text
            for _, _, inside, chain in found:
                if not inside:
                    branch = next((e for e in chain if e.tag not in ("", "html", "body")), None)
                    if branch and (branch.meaning, branch.hint) == (PLAIN, 0.0) and not any(e.inside for e in chain):
                        kinds[branch.node] = (PLAIN, -HINT, kinds[branch.node][2])
        places = {node: (self._id("|".join(sorted(styles))), meaning, hint) for node, (meaning, hint, styles) in kinds.items()}
        return places, [(chain, line) for chain, line, _, _ in found]


_PLACES = T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("style", T.LongType()), T.StructField("meaning", T.DoubleType()), T.StructField("hint", T.DoubleType())]))
_BLOCKS = T.ArrayType(T.StructType([T.StructField("chain", T.ArrayType(T.LongType())), T.StructField("line", T.StringType())]))


def parse(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Every row without its html, with host, places (node, style, meaning, hint) and blocks (chain of nodes, line); no shuffle."""
    arrow_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != html_col and c.lower() != "text"]
    names = [f"c{i}" for i in range(len(kept))]
    inner = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], parsed(F.col(f"`{url_col}`"))[0].alias("host__"), whole_text(html_col).alias("html__"))
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip([*names, "host__"], inner.schema.fields[:-1], strict=True)], T.StructField("places", _PLACES), T.StructField("blocks", _BLOCKS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        parser, arrow = Parser(), to_arrow_schema(schema)
        for batch in batches:
            for part, texts in blocks(batch, len(names) + 1):
                done = [parser.parse(t) for t in texts]
                places = [[{"node": n, "style": s, "meaning": m, "hint": h} for n, (s, m, h) in x.items()] for x, _ in done]
                lines = [[{"chain": c, "line": t} for c, t in x] for _, x in done]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(places, arrow.field("places").type), pa.array(lines, arrow.field("blocks").type)], names=arrow.names)

    out = inner.mapInArrow(worker(work), schema)
    return out.select(F.struct(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)]).alias("row_"), F.col("host__").alias("host"), "places", "blocks")


def importance(read: DataFrame) -> DataFrame:
    """host, node, imp, keep_odds: composite importance, and log odds that the branch at a place of a host is main text."""
    place = read.select("host", F.explode("places").alias("p")).select("host", "p.*")
    means = [F.sum(c).alias(c) for c in ("meaning", "hint")]
    styles = written(place.groupBy("host", "node", "style").agg(F.count(F.lit(1)).alias("n"), *means), "styles")
    content = read.select("host", F.explode("blocks").alias("b"))
    line = F.when(F.col("host") == "", F.col("b.line")).otherwise(F.replace(F.lower("b.line"), F.col("host"), F.lit("")))
    content = content.select("host", F.element_at("b.chain", -1).alias("node"), F.xxhash64(line).alias("line"), "b.chain")
    lines = written(content.groupBy("host", "node", "line").agg(F.count(F.lit(1)).alias("n"), F.first("chain").alias("chain")), "lines")

    def measured(by: list[str], styles: DataFrame, lines: DataFrame, tag: str) -> DataFrame:
        kinds = styles.groupBy(*by).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count(F.lit(1)).alias("l"), *means)
        kinds = kinds.withColumn("style_imp", F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(1.0))
        # lines by how often they occur, counted before the shuffle: a hot place has few such rows
        often = lines.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("lines"), F.first("chain").alias("chain"))
        known = often.join(kinds.select(*by, "m"), by)
        new = 1 - F.least(F.when(F.col("m") > 1, F.log("n") / F.log(F.col("m"))).otherwise(0.0), F.lit(1.0))
        mean = F.sum(new * F.col("lines")) / F.sum("lines")
        leaf = known.groupBy(*by).agg(mean.alias("content"), F.sum(F.col("n") * F.col("lines")).alias("n"), F.first("chain").alias("chain"))
        above = [c for c in by if c != "node"]
        spread = leaf.select(*above, F.explode(F.array_distinct("chain")).alias("node"), "content", "n")
        below = spread.groupBy(*by).agg((F.sum(F.col("content") * F.col("n")) / F.sum("n")).alias("content"))
        both = kinds.join(below, by, "left")
        part = F.pow(F.lit(GAMMA), F.col("l"))
        imp = F.when(F.col("content").isNull(), F.col("style_imp")).otherwise((1 - part) * F.col("style_imp") + part * F.col("content"))
        mean = [(F.col(c) / F.col("m")).alias(f"{c}_{tag}") for c in ("meaning", "hint")]
        return both.select(*by, F.col("m").alias(f"m_{tag}"), *mean, imp.alias(f"imp_{tag}"))

    of_host = written(measured(["host", "node"], styles, lines, "host"), "of-host")
    all_styles = styles.groupBy("node", "style").agg(F.sum("n").alias("n"), *means)
    all_lines = lines.groupBy("node", "line").agg(F.sum("n").alias("n"), F.first("chain").alias("chain"))
    overall = written(measured(["node"], all_styles, all_lines, "all"), "overall")
    whole = overall.where(F.col("node") == ROOT).select("imp_all").first()  # one row
    less = F.greatest(F.lit(whole[0] if whole else 0.0) - F.col("imp_host"), F.lit(0.0)).alias("less")
    pages_ = written(of_host.where(F.col("node") == ROOT).select("host", less), "pages")
    both = per_key(of_host.join(overall, "node"), pages_, "host", F.col("node"))
    seen = F.col("m_host") - 1.0
    own = F.least(F.col("imp_host") + F.coalesce("less", F.lit(0.0)), F.lit(1.0))
    both = both.withColumn("imp", (seen * own + WEIGHT * F.col("imp_all")) / (seen + WEIGHT))
    trust = F.log(F.greatest("m_host", "m_all") / UNSURE) / F.log(F.lit(SURE / UNSURE))
    trust = F.least(F.greatest(trust, F.lit(0.0)), F.lit(1.0))
    pull = F.least(F.greatest(PULL * (F.col("imp") - MIDDLE), F.lit(DOWN)), F.lit(UP))
    return both.select("host", "node", "imp", (F.col("meaning_host") + (1 - trust) * F.col("hint_host") + trust * pull).alias("keep_odds"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Every row of ``pages`` without its html, with ``text``."""
    read = written(parse(pages, html_col, url_col).withColumn("rid", F.monotonically_increasing_id()), "parsed")
    low = written(importance(read).where("keep_odds < 0").select("host", "node"), "removed")
    many = low.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOST_PLACES).select("host")
    few = low.join(many, "host", "left_anti").groupBy("host").agg(F.collect_set("node").alias("gone"))  # HOST_PLACES at most
    known = per_key(read, written(few, "removed"), "host", F.col("rid"))
    if not many.isEmpty():  # hosts with more are decided by each page's own places
        places = read.join(many, "host", "left_semi").select("rid", "host", F.explode("places.node").alias("node"))
        own = places.join(low, ["host", "node"], "left_semi").groupBy("rid").agg(F.collect_set("node").alias("own"))
        known = known.join(own, "rid", "left").withColumn("gone", F.coalesce("gone", "own"))
    left = F.filter("blocks", lambda b: F.coalesce(~F.arrays_overlap(b["chain"], F.col("gone")), F.lit(True)))
    return known.select("row_.*", F.array_join(F.transform(left, lambda b: b["line"]), "\n").alias("text"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
