"""Main text of pages by template deduction from equivalence classes.

A page is a row of tokens: opening and closing tags with their path in the
document tree, and short pieces of text with theirs. Tokens that occur equally
often on every page of a host share an occurrence vector and form a class.
Classes that are once on each of most pages, with their tokens in one order on
most of those that have them, are valid and make up the root of the template.
The gaps between its tokens are slots; the root element whose gaps hold most
unlinked words over all pages of the host, outside menus and the like, is the
main element, and a page's text is what that element holds, less the template's
own text: pieces that are said as often as their element occurs, in the root or
in a class that nests in one of its gaps (as labels of repeated elements do).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, cut, fresh
from .url_filter import split_url

#: Words of a text piece that is its own token; a longer one's is its hash.
TOKEN_WORDS = 8
#: Open elements whose path grows; deeper ones stand at that depth, as browsers
#: have it, so that paths stay short.
MAX_DEPTH = 256
#: Share of a group's pages that a class is on at least, and pages of a host
#: below which the pages of all such hosts are one group.
SUPPORT, LEAST_PAGES = 0.5, 3
#: Share of a group's pages with elements that a root token is once on at least,
#: and of the pages of a root class that have its tokens in order.
ROOT_SHARE = 0.65
#: Share of the pages with an element whose text is the same that make the text
#: part of the template, and such pages at least (copies count as one).
TEXT_SHARE, TEXT_PAGES = 0.9, 3
#: Characters of all templates together that are broadcast; else they are joined.
MAX_BROADCAST = 48_000_000
#: Hosts of few pages that are broadcast; else they are joined.
MAX_HOSTS = 300_000

#: A tag has no "<" but in quotes, so that no piece is scanned again and again.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\w[^<>]*>|<\?[^<>]*>|<(script|style|noscript|template|svg|iframe|textarea|select|object)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong strike sub sup time tt u var ins del big".split())
#: Elements that a new one of the key's kind closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES_P = frozenset("article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
SCOPE = frozenset("ul ol dl table article section div body html td th main aside nav footer header form".split())
#: Elements that are parts of a text.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li blockquote table".split())
#: Elements and name parts of what is not the main text.
ASIDE_TAGS = frozenset("nav header footer aside form head title button dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"sidebar|side|aside|widget|footer|foot|header|masthead|topbar|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommended|comment|comments|respond|disqus|replies|reply|pagination|pager|toolbar|search)(?:$|[\s_-])",
    re.I,
)


def _names(attributes: str) -> tuple[str, str]:
    """The class and id of a tag as one string, and its role."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    return f"{found.get('class', '')} {found.get('id', '')}".strip().lower(), found.get("role", "").strip().lower()


class Page:
    """tokens: (key, kind); texts: (token place, path, block, linked, aside,
    text); a path is the keys of open elements that aren't inline."""

    def __init__(self, html: str | None):
        self.tokens: list[str] = []
        self.texts: list[tuple[int, str, int, bool, bool, str]] = []
        stack: list[tuple[str, str, bool]] = []  # tag, path, aside
        opened: Counter = Counter()  # tags on the stack
        ends: dict[str, str] = {}  # closing tokens, once each
        links, block = 0, 0
        for m in TOKEN.finditer(html or ""):
            piece = m[0]
            tag = (m[3] or "").lower()
            if not tag:
                if m[1] or piece.startswith("<!") or piece.startswith("<?"):
                    if m[1] and m[1].lower() not in ("script", "style"):
                        block += 1
                    continue
                path, aside = (stack[-1][1], stack[-1][2]) if stack else ("", False)
                self.texts.append((len(self.tokens), path, block, links > 0, aside, piece))
                words = piece.split()
                if words:
                    said = " ".join(words)
                    self.tokens.append(f"{path}#{said if len(words) <= TOKEN_WORDS else _hash(said)}")
                continue
            if tag in INLINE:
                if tag == "a":
                    links = max(0, links + (-1 if m[2] else 1))
                continue
            if tag == "br":
                path, aside = (stack[-1][1], stack[-1][2]) if stack else ("", False)
                self.texts.append((len(self.tokens), path, block, links > 0, aside, " "))
                continue
            block += 1
            if m[2]:
                if opened[tag]:
                    while True:
                        shut_tag, path, _ = stack.pop()
                        opened[shut_tag] -= 1
                        if shut_tag == tag:
                            break
                    self.tokens.append(ends.setdefault(path, f"{path}>"))
                    links = 0
                continue
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if any(opened[t] for t in shut):
                k, stop = len(stack) - 1, SCOPE | {tag} - shut
                while k >= 0 and stack[k][0] not in stop:
                    if stack[k][0] in shut:
                        opened.subtract(t for t, _, _ in stack[k:])
                        del stack[k:]
                    k -= 1
            names, role = _names(m[4] or "")
            path, aside = (stack[-1][1], stack[-1][2]) if stack else ("", False)
            first = re.sub(r"[/#>]", "_", names.split()[0]) if names else ""  # these part a token
            if len(stack) < MAX_DEPTH:
                path = f"{path}/{tag}{'.' + first if first else ''}"
            aside = aside or tag in ASIDE_TAGS or role in ASIDE_ROLES or bool(names and ASIDE_NAMES.search(names))
            self.tokens.append(path)
            if tag not in VOID:
                stack.append((tag, path, aside))
                opened[tag] += 1
                links = 0

    def token(self, place: int, piece: str) -> str | None:
        """The token of a text piece; blank ones have none."""
        return self.tokens[place] if piece.strip() else None

    def text(self, container: str | None, fixed: frozenset[str] = frozenset()) -> str | None:
        """The blocks in the container, without asides that are inside it and
        without fixed text tokens; None if the page has no such element."""
        if container is None or container not in self.tokens:
            return None
        inner = f"{container}/"
        blocks: dict[int, list[str]] = {}
        for place, path, block, _, aside, piece in self.texts:
            if not aside and (path == container or path.startswith(inner)) and self.token(place, piece) not in fixed:
                blocks.setdefault(block, []).append(piece)
        said = (" ".join(unescape("".join(b)).split()) for b in blocks.values())
        return "\n\n".join(b for b in said if b)

    def plain(self, fixed: frozenset[str] = frozenset()) -> str:
        """Without a template: the first of article, main, a role or name of
        such, or body; else everything that is no aside."""
        opened = [t for t in self.tokens if not t.endswith(">") and "#" not in t]
        last = lambda t: t.rpartition("/")[2]
        for fits in (lambda k: k.partition(".")[0] == "article", lambda k: k.partition(".")[0] == "main", lambda k: re.search(r"\.(?:content|main|post|entry|article|story|body)", k), lambda k: k == "body"):
            for t in opened:
                if fits(last(t)) and (got := self.text(t, fixed)):
                    return got
        blocks: dict[int, list[str]] = {}
        for place, _, block, _, aside, piece in self.texts:
            if not aside and self.token(place, piece) not in fixed:
                blocks.setdefault(block, []).append(piece)
        said = (" ".join(unescape("".join(b)).split()) for b in blocks.values())
        return "\n\n".join(b for b in said if b)


def _hash(*parts) -> int:
    """40 bits, so that sums over very many pages stay in a long."""
    return xxhash.xxh3_64_intdigest("|".join(map(str, parts)).encode("utf-8", "replace")) >> 24


def _occurrences(pages: DataFrame) -> DataFrame:
    """host, token, pages, vector (sum of hashes of page and count), once (pages
    that have it once), place (sum of relative places); token "" counts the
    pages that have elements. A page with n copies counts 1 / n for each."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out: dict[tuple[str, str], list] = defaultdict(lambda: [0.0, 0, 0.0, 0.0])
            for host, key, html, copies in zip(pdf["host"], pdf["key"], pdf["html"], pdf["copies"], strict=True):
                tokens = Page(html).tokens
                first: dict[str, int] = {}
                for i, t in enumerate(tokens):
                    first.setdefault(t, i)
                counted = [("", 1)] if any("#" not in t for t in first) else []
                for t, n in [*Counter(tokens).items(), *counted]:
                    o = out[host, t]
                    o[0] += 1 / copies
                    o[1] += _hash(key, n)
                    o[2] += (n == 1) / copies
                    o[3] += first.get(t, 0) / max(1, len(tokens)) / copies
            yield pd.DataFrame([(h, t, *o) for (h, t), o in out.items()], columns=["host", "token", "pages", "vector", "once", "place"])

    found = pages.mapInPandas(run, "host string, token string, pages double, vector long, once double, place double")
    # sums of shares hang on their order; nine digits do not
    sums = [F.round(F.sum(c), 9).alias(c) for c in ("pages", "once", "place")]
    return found.groupBy("host", "token").agg(sums[0], F.sum("vector").alias("vector"), *sums[1:])


def _with_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """A template per page's group: broadcast if all of them are small."""
    size = templates.agg(F.sum(F.octet_length(F.to_json(F.struct(*[c for c in templates.columns if c != "host"]))))).first()[0] or 0
    return pages.join(F.broadcast(templates) if size <= MAX_BROADCAST else templates, "host", "left")


def _evidence(pages: DataFrame) -> DataFrame:
    """host, kind, name, good, seen, words: for each class (kind c) the pages
    that have it and those on which its tokens keep their order, and lie in one
    gap of the root unless they are of it; for each gap (kind g, named by the
    root token before it, and a template text or -1) its unlinked words outside
    asides."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out: dict[tuple, list] = defaultdict(lambda: [0.0, 0.0, 0.0])
            for host, html, copies, tokens, classes in zip(pdf["host"], pdf["html"], pdf["copies"], pdf["tokens"], pdf["classes"], strict=True):
                if tokens is None or not len(tokens):
                    continue
                page = Page(html)
                where: dict[str, list[int]] = defaultdict(list)
                for i, t in enumerate(page.tokens):
                    where[t].append(i)
                groups, marks, index = defaultdict(list), [], {}
                for k, (t, c) in enumerate(zip(tokens, classes, strict=True)):
                    index[t] = k
                    groups[c].append(t)
                    if c.startswith("root") and t in where:
                        marks.append((where[t][0], k))
                # the root token before each place on the page
                marks.sort()
                gap, at, k = [], -1, 0
                for i in range(len(page.tokens) + 1):
                    while k < len(marks) and marks[k][0] < i:
                        at, k = marks[k][1], k + 1
                    gap.append(at)
                for name, own in groups.items():
                    if name.startswith("root"):
                        places = [where[t][0] for t in own if t in where]
                        good = places == sorted(places)
                    else:
                        seen = sorted((i, j) for j, t in enumerate(own) for i in where.get(t, ()))
                        places = [i for i, _ in seen]
                        good = all(j == i % len(own) for i, (_, j) in enumerate(seen)) and len({gap[i] for i in places}) == 1
                    if places:
                        o = out[host, "c", name]
                        o[0] += good / copies
                        o[1] += 1 / copies
                for place, _, _, linked, aside, piece in page.texts:
                    if not linked and not aside and gap[place] >= 0:
                        out[host, "g", f"{gap[place]}:{index.get(page.token(place, piece), -1)}"][2] += len(piece.split()) / copies
            yield pd.DataFrame([(*key, *o) for key, o in out.items()], columns=["host", "kind", "name", "good", "seen", "words"])

    found = pages.mapInPandas(run, "host string, kind string, name string, good double, seen double, words double")
    return found.groupBy("host", "kind", "name").agg(*[F.round(F.sum(c), 9).alias(c) for c in ("good", "seen", "words")])


def templates(pages: DataFrame) -> DataFrame:
    """host, tokens, classes of each group: its classes on SUPPORT of the pages,
    in order of their mean place. A group's tokens are at most the tokens of a
    page over SUPPORT, whatever the number of its pages."""
    seen = cut(_occurrences(pages))
    total = seen.where("token = ''").select("host", F.col("pages").alias("of"))
    often = seen.where("token <> ''").join(total, "host").where((F.col("pages") >= SUPPORT * F.col("of")) & (F.col("pages") >= 2))
    entry = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", "pages", "vector", "once")
    both = often.groupBy("host").agg(F.first("of").alias("of"), F.sort_array(F.collect_list(entry)).alias("all"))

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for host, of, every in zip(pdf["host"], pdf["of"], pdf["all"], strict=True):
                named = classed([(e["token"], e["pages"], e["vector"], e["once"]) for e in every], of)
                out.append((host, [t for t, _ in named], [c for _, c in named]))
            yield pd.DataFrame(out, columns=["host", "tokens", "classes"])

    return both.mapInPandas(run, "host string, tokens array<string>, classes array<string>")


def classed(rows: list[tuple[str, float, int, float]], of: float) -> list[tuple[str, str]]:
    """(token, class) of the frequent tokens (token, pages, vector, once).

    An element that is once on each of most pages, inside one such, is of the
    root; others can nest in it. A text is of the template if its element, as
    often as it occurs, has it: else it only happens to be on many pages.
    """
    facts = {t: (pages, vector, once) for t, pages, vector, once in rows}
    root: set[str] = set()
    for t in sorted(facts, key=len):  # an element before what is in it
        up = t.rpartition("/")[0]
        if "#" not in t and not t.endswith(">") and facts[t][2] >= ROOT_SHARE * of and (not up or up in root):
            root.add(t)
    out = []
    for t, pages, vector, once in rows:
        element, is_text, _ = t.partition("#")
        if is_text:
            near = facts.get(element)
            if near is None or pages < TEXT_PAGES:
                continue
            if element in root:
                if once < ROOT_SHARE * of or pages < TEXT_SHARE * near[0]:
                    continue
            elif vector != near[1]:
                continue
        of_root = t in root or (is_text and element in root) or (t.endswith(">") and t[:-1] in root and once >= ROOT_SHARE * of)
        out.append((t, f"{'root:' if of_root else ''}{vector}"))
    return out


def containers(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, container, fixed: the element around the slots with most words,
    null where no template element is, and the texts of the template. Classes
    that keep their order, or nest, on too few pages are dropped; their gaps
    count for the elements around them."""
    evidence = cut(_evidence(_with_templates(pages, found)))
    kept = (F.col("kind") == "c") & (F.col("good") >= ROOT_SHARE * F.col("seen"))
    place = F.split("name", ":")
    facts = evidence.groupBy("host").agg(
        F.collect_set(F.when(kept, F.col("name"))).alias("valid"),
        F.collect_list(F.when((F.col("kind") == "g") & (F.col("words") > 0), F.struct(place[0].cast("int").alias("at"), place[1].cast("int").alias("text"), "words"))).alias("gaps"),
    )

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for host, tokens, classes, valid, gaps in zip(pdf["host"], pdf["tokens"], pdf["classes"], pdf["valid"], pdf["gaps"], strict=True):
                keep = set(valid)
                template = [(t, c) for t, c in zip(tokens, classes, strict=True) if c in keep]
                root, fixed = {t for t, c in template if c.startswith("root")}, {t for t, _ in template if "#" in t}
                words: Counter = Counter()
                for g in sorted(gaps, key=lambda g: (g["at"], g["text"])):
                    if g["text"] < 0 or tokens[g["text"]] not in fixed:
                        words[around(tokens[g["at"]], root)] += g["words"]
                out.append((host, max(words, key=words.get) if words else None, sorted(fixed)))
            yield pd.DataFrame(out, columns=["host", "container", "fixed"])

    return found.join(facts, "host").mapInPandas(run, "host string, container string, fixed array<string>")


def around(token: str, root: set[str]) -> str | None:
    """The path of the innermost root element that is open after a token. A
    paragraph, heading or the like is only part of the main element; the whole
    body is none."""
    path = token.partition("#")[0]
    tag = path.rpartition("/")[2].partition(".")[0]
    if path.endswith(">") or (tag in VOID and "#" not in token):
        path = path.rpartition("/")[0]
    while path and (path not in root or path.rpartition("/")[2].partition(".")[0] in PARTS):
        path = path.rpartition("/")[0]
    return path if path.rpartition("/")[2] not in ("", "html", "body") else None


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds text and n_chars to every page (and host, container: how).

    Null or empty html gives an empty text. Null urls and urls without a host
    are one group, as are hosts of fewer than LEAST_PAGES pages. Where a group
    has no valid template, or a page not its main element, the page's own
    article, main or body element is taken. Texts of the template are left out
    wherever they are. Repeated pages are extracted each, but count as one;
    an empty table gives no rows; input columns of these names are replaced.
    """
    names = [c for c in ("host", "key", "html", "container", "text", "n_chars", "tokens", "classes") if c not in (id_col, url_col, html_col)]
    own_host, own_html, group, said = (fresh(pages, c) for c in ("host", "html", "group", "fixed"))
    clean = clear_names(pages, *names)
    base = clean.withColumns({own_host: split_url(F.col(url_col))[0], own_html: F.col(html_col).cast("string")})
    sizes = base.groupBy(own_host).agg(F.count("*").alias("n"))
    few = cut(sizes.where(F.col("n") < LEAST_PAGES).select(own_host, F.lit("").alias(group)))
    keyed = base.join(F.broadcast(few) if few.count() <= MAX_HOSTS else few, own_host, "left").withColumn(group, F.coalesce(group, own_host))
    narrow = keyed.select(F.col(group).alias("host"), F.xxhash64(F.col(id_col), F.col(url_col)).alias("key"), F.col(own_html).alias("html"), F.xxhash64(own_html).alias("print"))
    copied = cut(narrow.groupBy("host", "print").agg(F.count("*").alias("copies")).where(F.col("copies") > 1))
    narrow = narrow.join(F.broadcast(copied) if copied.count() <= MAX_HOSTS else copied, ["host", "print"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    found = cut(templates(narrow.select("host", "key", "html", "copies")))
    where = cut(containers(narrow.select("host", "html", "copies"), found).withColumnRenamed("fixed", said))

    @F.pandas_udf("string")
    def main_text(htmls: pd.Series, elements: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for html, element, said in zip(htmls, elements, texts, strict=True):
            page, fixed = Page(html), frozenset(() if said is None else said)
            out.append(page.text(element, fixed) or page.plain(fixed))
        return pd.Series(out, dtype=object)

    out = _with_templates(keyed.withColumnRenamed(group, "host"), where)
    out = out.withColumn("text", main_text(own_html, "container", said)).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.drop(own_host, own_html, said)
