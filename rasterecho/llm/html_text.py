"""Main text of pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of tags and words. Each kind of token (a word by the block it stands in, a tag by its name) weighs the log odds
of standing inside the content of the labelled pages below; one linear scan finds the contiguous region with the largest sum. The
region grows to the element that holds all of it (not beyond a container that also holds other regions' boilerplate), and blocks inside
it that are menus, adverts, forms, notices or comments by name are left out. A name is a whole class or id, and only a guess: a block so
named is read after all if no article or main part has text and the block's own region far outweighs what is found elsewhere. No such
block and no element around it hides the main part, or the articles that stand in the fewest of them.

Edge cases: null, empty or wordless html gives an empty text; unclosed and stray tags are closed as they can be; a page cut off in a tag
ends there; very long pages take linear time; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: (before, content, after) of small pages labelled by hand.
LABELLED_PAGES = (
    ("<html><head><title>News of today</title><script>x</script></head><body><nav><ul><li><a>Home</a></li><li><a>World</a></li><li><a>Sport</a></li></ul></nav><div>Buy now cheap</div>",
     "<h1>A long day at the river</h1><p>The water rose in the night and the people of the town left for the hills above it.</p><p><b>In the morning</b> they saw what was left of the bridge and of the road that had led there.</p><p>No one was hurt.</p>",
     "<footer>All rights reserved <a>Imprint</a> <a>Contact</a></footer></body></html>"),
    ("<html><body><header><a>Blog</a><ul><li><a>About</a></li><li><a>Archive</a></li></ul></header><form><label>Search</label><input><button>Go</button></form>",
     "<h1>Bread at home</h1><p>Flour, water, salt and time are all that is needed for a good loaf.<br>Mix them in the evening and let them rest.</p><h2>Baking</h2><p>Heat the oven for an hour.</p><p>Then bake until brown, which takes about forty minutes in most ovens.</p>",
     "<aside><ul><li><a>Older post</a></li><li><a>Newer post</a></li></ul></aside><div><form><label>Your comment</label><textarea></textarea><button>Send</button></form></div><footer>Powered by a blog</footer></body></html>"),
    ("<html><head><style>p</style></head><body><div>We use cookies <button>Accept</button></div><nav><a>One</a><a>Two</a><a>Three</a></nav><table><tr><td><a>Menu</a></td></tr></table>",
     "<p>When the train came in the station was already full and many had to wait for the next.</p><p>She read the letter again. <i>It said little</i> but it said enough to go on.</p><p>The next one came at noon.</p>",
     "<div><a>Share</a><a>Print</a></div><div>Related <ul><li><a>More trains</a></li></ul></div><footer>Contact us</footer></body></html>"),
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<![^>]*>|<\?[^>]*>", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("head title script style noscript template nav footer aside form button select option textarea input iframe svg object dialog menu label".split())
_CLOSED_BY_BLOCK = frozenset(["p"])
_NAME = re.compile(
    r"ads?|adsby\w+|advert\w*|sponsor\w*|promo\w*|banners?|(?:side|nav|menu)bar|sidebars?|side|menus?|nav|navigation|breadcrumbs?|footers?|"
    r"comments?|comment(?:list|s?area|box|form)|disqus\w*|respond|replies|cookies?|consent|gdpr|notices?|popups?|modal|newsletters?|subscribe|"
    r"share|sharing|social|related|widgets?|toolbar|login|search", re.I)
#: Parts of a class that turn a name beside them into a word on layout: has-sidebar or search-results name no boilerplate.
_LAYOUT = frozenset("has no not with without is are open opened closed enabled disabled active results result hidden visible page-wrap".split())
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
#: What a named block costs when it is read after all, and how many times the region elsewhere it must outweigh.
NAMED_COST, NAMED_TIMES = 10.0, 3.0


def tokens_of(page: str) -> list[tuple]:
    """('word', text, block) and ('open' | 'close', tag, attributes) in page order; scripts and comments are gone."""
    out: list[tuple] = []
    stack: list[str] = []
    blocks = [""]  # for each depth the innermost element that is no mere style, so that no text has to look for it
    open_tags: Counter[str] = Counter()
    at = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop()
            blocks.pop()
            open_tags[tag] -= 1
            out.append(("close", tag, ""))

    def text(raw: str) -> None:
        if raw:
            out.append(("word", html.unescape(raw), blocks[-1]))

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if open_tags[tag]:
                while stack[-1] != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
            continue
        if tag not in _INLINE and tag not in _VOID:
            # A block ends an open paragraph and what is inside it; a list item ends the one before it.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in _CLOSED_BY_BLOCK or stack[i] == tag == "li":
                    close(i)
                    break
                if stack[i] not in _INLINE:
                    break
        out.append(("open", tag, m[4]))
        if tag in _VOID or m[4].endswith("/"):
            out.append(("close", tag, ""))
        else:
            stack.append(tag)
            blocks.append(tag if tag not in _INLINE or tag == "a" else blocks[-1])
            open_tags[tag] += 1
    text(page[at:])
    close(0)
    return out


def _kinds(token: tuple) -> tuple[str, int]:
    if token[0] == "word":
        return f"word {token[2]}", len(token[1].split())
    return f"{token[0]} {token[1]}", 1


class Weights:
    """Log odds of token kinds between content and the rest of labelled pages."""

    def __init__(self, pages=LABELLED_PAGES) -> None:
        inside, outside = Counter(), Counter()
        for before, content, after in pages:
            for part, counts in ((before, outside), (content, inside), (after, outside)):
                for t in tokens_of(part):
                    kind, n = _kinds(t)
                    counts[kind] += n
        n_in, n_out, kinds = sum(inside.values()), sum(outside.values()), len(inside | outside)
        self.of = {k: math.log((inside[k] + 1) / (n_in + kinds)) - math.log((outside[k] + 1) / (n_out + kinds)) for k in inside | outside}

    def __call__(self, token: tuple) -> float:
        kind, n = _kinds(token)
        if kind in self.of:
            score = self.of[kind] * n
            return max(score, -0.5) if token[0] != "word" and token[1] in ("p", "br", "b", "i", "h1", "h2") else score
        return 0.5 * n if token[0] == "word" else (-0.2 if token[1] in _INLINE else -0.8)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end place of the contiguous part with the largest sum; (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


HARD, SOFT = "hard", "soft"


def _named(value: str) -> bool:
    """Whether a class, id or role names boilerplate: one of its parts is such a name, and no part beside it is a word on layout."""
    for name in value.split():
        parts = _PARTS.split(name)
        if any(_NAME.fullmatch(p) for p in (name, *parts)) and not any(p.lower() in _LAYOUT for p in parts):
            return True
    return False


def _boilerplate(token: tuple) -> str | None:
    """Whether an element is left out for what it is (HARD), or for what it seems to be by name (SOFT; forms may hold whole pages)."""
    if token[1] in _NEVER and token[1] != "form":
        return HARD
    named = token[1] == "form"
    for name, a, b, c in _ATTR.findall(token[2]):
        name = name.lower()
        if name == "hidden" or name == "style" and _NO_DISPLAY.search(a or b or c):
            return HARD
        named = named or name in ("class", "id", "role") and _named(a or b or c)
    return SOFT if named else None


class _Frames:
    """The innermost boilerplate, article or main element of each token, and which of them are left out."""

    def __init__(self, tokens: list[tuple]) -> None:
        self.kind, self.parent, self.open_at, self.words, self.level = ["root"], [0], [-1], [0], [0]
        self.of: list[int] = []
        stack, depth, inside = [(0, 0)], 0, 0
        for i, t in enumerate(tokens):
            if t[0] == "open":
                depth += 1
                kind = t[1] if t[1] in ("article", "main") else None if t[1] in ("html", "body") else _boilerplate(t)
                if t[1] in ("article", "main"):
                    inside += 1
                elif t[1] == "header" and not inside:
                    kind = HARD
                if kind:
                    top = stack[-1][0]
                    stack.append((len(self.kind), depth))
                    self.kind.append(kind), self.parent.append(top), self.open_at.append(i), self.words.append(0)
                    self.level.append(self.level[top] + (kind in (HARD, SOFT)))
            self.of.append(stack[-1][0])
            if t[0] == "word":
                self.words[stack[-1][0]] += len(t[1].split())
            elif t[0] == "close":
                if stack[-1][1] == depth:
                    stack.pop()
                inside -= t[1] in ("article", "main")
                depth -= 1
        for f in range(len(self.kind) - 1, 0, -1):
            self.words[self.parent[f]] += self.words[f]
        text = [f for f, k in enumerate(self.kind) if k in ("article", "main") and self.words[f]]
        least = min((0 if self.kind[f] == "main" else self.level[f] for f in text), default=0)
        self.lifted = {f for f in text if self.kind[f] == "main" or self.level[f] == least}
        #: An article that is not lifted counts to what it stands in.
        self.owner, self.held = [0], [False]
        for f in range(1, len(self.kind)):
            self.owner.append(f if self.kind[f] in (HARD, SOFT) or f in self.lifted else self.owner[self.parent[f]])
            self.held.append(self.kind[f] == HARD or f not in self.lifted and self.held[self.parent[f]])
        self.read = {f for f in range(len(self.kind)) if f == 0 or f in self.lifted}

    def skipped(self, i: int) -> bool:
        return self.owner[self.of[i]] not in self.read

    def scores(self, tokens: list[tuple], raw: list[float]) -> list[float]:
        """Weights of the tokens; boilerplate by name weighs against the region with all that is in it."""
        out = [min(w, -0.05 * (len(t[1].split()) if t[0] == "word" else 1)) if self.skipped(i) else w for i, (t, w) in enumerate(zip(tokens, raw, strict=True))]
        for f in self.read:
            if self.kind[f] == SOFT:
                out[self.open_at[f]] -= NAMED_COST
        return out

    def outweighing(self, raw: list[float], elsewhere: float) -> int | None:
        """The named block with the largest region of its own, if that is far larger than the one elsewhere."""
        best, total = {}, {}
        for i, w in enumerate(raw):
            f = self.owner[self.of[i]]
            if self.kind[f] == SOFT and f not in self.read and not self.held[self.parent[f]]:
                total[f] = max(0.0, total.get(f, 0.0)) + w
                best[f] = max(best.get(f, 0.0), total[f])
        top = max(best, key=best.get, default=None)
        return top if top is not None and best[top] - NAMED_COST > NAMED_TIMES * elsewhere else None


def main_text(page: str | None, weights: Weights) -> str:
    tokens = tokens_of(page or "")
    frames, raw = _Frames(tokens), [weights(t) for t in tokens]
    while True:
        # Each block read makes the region over NAMED_TIMES as large, so there are few rounds.
        scores = frames.scores(tokens, raw)
        first, end = best_region(scores)
        more = None if frames.lifted else frames.outweighing(raw, sum(scores[first:end]))
        if more is None:
            break
        frames.read.add(more)
    skipped = [frames.skipped(i) for i in range(len(tokens))]
    if first == end:
        return ""
    # The element that holds the region, if it is an article, a main part or another plain container below the body.
    path: list[int] = []
    holder: list[int] | None = None
    for i, t in enumerate(tokens[:end]):
        if t[0] == "open":
            path.append(i)
        elif t[0] == "close":
            path.pop()
        if i == first:
            holder = list(path) if t[0] != "open" else list(path[:-1])
        elif i > first and holder is not None and len(path) < len(holder):
            holder = holder[: len(path)]
    while holder and tokens[holder[-1]][1] in _INLINE | {"p", "h1", "h2", "h3", "li"}:
        holder.pop()
    if holder and tokens[holder[-1]][1] not in ("html", "body"):
        inner = [i for i in holder if tokens[i][1] in ("article", "main")]
        first = inner[-1] if inner else holder[-1]
        level = 0
        for i in range(first, len(tokens)):
            level += (tokens[i][0] == "open") - (tokens[i][0] == "close")
            if level == 0:
                end = i + 1
                break
    parts: list[str] = []
    for t, off in zip(tokens[first:end], skipped[first:end], strict=True):
        if off:
            parts.append("\n") if t[0] != "word" and t[1] not in _INLINE else None
        elif t[0] == "word":
            parts.append(t[1])
        elif t[1] not in _INLINE:
            parts.append("\n")
    return " ".join("".join(parts).split())


_weights: list[Weights] = []


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _weights:
        _weights.append(Weights())
    for batch in batches:
        texts = [main_text(p, _weights[0]) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(_extract, f"id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
