"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between the tags of block elements. Each
block is described by its ancestors' tags, classes and ids and by its text; a chain over
the blocks says which are main text, decoded by Viterbi.

The field is fitted on a bounded sample of pages, labelled by their own markup where it
says what is what. Each is also used in variants whose containers bear other names and
which hold other kinds of side matter, so that pages without such markup are told apart.
Every page is read whole. A null or empty page has no text; an empty table has no rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import unused

#: Pages that the field is fitted on, at most, and the number of hashed features.
SAMPLE, FEATURES = 250, 1 << 12

# Fixed values of the HTML standard: elements with text that is not shown, those without an end tag, those inside lines.
HIDDEN = frozenset("script style noscript template title textarea svg math iframe object select option canvas head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Elements whose start ends an open one of the same group.
CLOSES = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S
)
_RAW = re.compile(r"<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_SPACES = re.compile(r"\s+")
_SIDE_TAGS = frozenset("nav footer aside form header menu dialog button".split())
_SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored sponsor promo promotion cookie cookies consent notice "
    "notification alert popup modal menu nav navigation navbar breadcrumb breadcrumbs sidebar widget footer header masthead "
    "comment comments reply replies discussion respond related recommended share sharing social newsletter subscribe signup "
    "login search pagination pager toc copyright legal".split()
)
_MAIN_NAMES = frozenset("article main content post entry story body text".split())


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: float) -> None:
        self.path, self.text, self.linked = path, text, linked


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for groups in _NAMED.findall(attributes):
        found += [p.lower() for p in _PARTS.findall("".join(groups))]
    return tuple(sorted(set(found)))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page that have text, in order; their paths hold (tag, names) of open elements."""
    page = _RAW.sub(" ", page) if "<" in page else page
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    texts: list[str] = []
    plain = linked = 0
    at = hidden = links = 0

    def close() -> None:
        nonlocal plain, linked, texts
        if texts:
            text = _SPACES.sub(" ", entities.unescape("".join(texts))).strip()
            if text:
                path = tuple(e for e in stack if e[0] not in INLINE)
                out.append(Block(path, text, linked / max(1, plain)))
            texts = []
        plain = linked = 0

    def pop(to: int) -> None:
        nonlocal hidden, links
        for tag, _ in stack[to:]:
            hidden -= tag in HIDDEN
            links -= tag == "a"
        del stack[to:]

    def text_of(piece: str) -> None:
        nonlocal plain, linked
        if piece and not hidden:
            texts.append(piece)
            size = len(piece.strip())
            plain += size
            linked += size if links else 0

    for m in _PIECE.finditer(page):
        text_of(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            texts.append(" ")
        elif m[1]:
            if tag not in INLINE:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
        else:
            if tag not in INLINE:
                close()
                group = CLOSES.get(tag)
                for i in range(len(stack) - 1, -1, -1):
                    open_tag = stack[i][0]
                    if open_tag == "p" or group and CLOSES.get(open_tag) == group:
                        pop(i)
                        break
                    if open_tag not in INLINE:
                        break
            if tag not in VOID and not m[3].endswith("/"):
                stack.append((tag, _names(m[3]) if m[3] else ()))
                hidden += tag in HIDDEN
                links += tag == "a"
    text_of(page[at:])
    close()
    return out


# --- features --------------------------------------------------------------------


@lru_cache(1 << 17)
def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


@lru_cache(1 << 15)
def _path_features(path: tuple) -> tuple[int, ...]:
    names = {"bias"}
    if path:
        names.add(f"own {path[-1][0]}")
    for tag, own in path:
        names.add(f"in {tag}")
        names.add("side tag" if tag in _SIDE_TAGS else "plain tag")
        for n in own:
            names.add(f"named {n}")
            if n in _SIDE_NAMES:
                names.add("side name")
            if n in _MAIN_NAMES:
                names.add("main name")
    return tuple(sorted({_hash(n) for n in names}))


def features(blocks: list[Block]) -> list[list[int]]:
    out = []
    for i, b in enumerate(blocks):
        size, text = len(b.text), b.text
        own = [
            f"size {min(8, size.bit_length())}",
            f"linked {int(4 * min(1.0, b.linked))}",
            f"ends {text[-1] if not text[-1].isalnum() else 'a'}",
            f"words {min(6, (text.count(' ') + 1).bit_length())}",
        ]
        if i == 0:
            own.append("first")
        if i == len(blocks) - 1:
            own.append("last")
        if "\N{COPYRIGHT SIGN}" in text or "All rights" in text:
            own.append("copyright")
        out.append([*_path_features(b.path), *map(_hash, own)])
    return out


def marked(block: Block) -> int | None:
    """What the markup itself says: 1 main text, 0 not, None nothing."""
    main = False
    for tag, names in block.path:
        if tag == "header" and main:
            continue
        if tag in _SIDE_TAGS or not _SIDE_NAMES.isdisjoint(names):
            return 0
        main |= tag in ("article", "main") or not _MAIN_NAMES.isdisjoint(names)
    return 1 if main else None


# --- the field -------------------------------------------------------------------


class Field:
    """Two labels; a weight per label and feature, and per pair of neighbouring labels."""

    def __init__(self) -> None:
        self.w, self.t = np.zeros((FEATURES, 2)), np.zeros((2, 2))

    def _scores(self, rows: list[list[int]]) -> np.ndarray:
        sizes = [len(r) for r in rows]
        flat = np.fromiter((x for r in rows for x in r), np.int64, sum(sizes))
        return np.add.reduceat(self.w[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not rows:
            return []
        (t00, t01), (t10, t11) = self.t.tolist()
        scores = self._scores(rows).tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            from0, from1 = a + t00 >= b + t10, a + t01 > b + t11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = x + (a + t00 if from0 else b + t10), y + (a + t01 if from1 else b + t11)
        label = int(b > a)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], epochs: int = 6, rate: float = 0.3, seed: int = 8) -> Field:
        """Likelihood ascent by forward and backward sums, with a rate per feature."""
        shuffle = np.random.default_rng(seed)
        square_w, square_t = np.full((FEATURES, 2), 1e-2), np.full((2, 2), 1e-2)
        for _ in range(epochs):
            for i in shuffle.permutation(len(pages)):
                rows, labels = pages[i]
                s = self._scores(rows)
                n = len(s)
                alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
                alpha[0] = s[0]
                for k in range(1, n):
                    alpha[k] = s[k] + np.logaddexp(alpha[k - 1, 0] + self.t[0], alpha[k - 1, 1] + self.t[1])
                for k in range(n - 2, -1, -1):
                    onward = self.t + (s[k + 1] + beta[k + 1])[None, :]
                    beta[k] = np.logaddexp(onward[:, 0], onward[:, 1])
                total = np.logaddexp(*alpha[-1])
                gradient = -np.exp(alpha + beta - total)
                gradient[np.arange(n), labels] += 1
                step_t = -1e-4 * self.t
                for k in range(1, n):
                    step_t -= np.exp(alpha[k - 1][:, None] + self.t + (s[k] + beta[k])[None, :] - total)
                    step_t[labels[k - 1], labels[k]] += 1
                flat = np.concatenate(rows).astype(int)
                each = np.repeat(gradient, [len(r) for r in rows], axis=0)
                np.add.at(square_w, flat, each**2)
                np.add.at(self.w, flat, rate * each / np.sqrt(square_w[flat]))
                square_t += step_t**2
                self.t += rate * step_t / np.sqrt(square_t)
        return self


#: Side matter of variants: what opens and closes it.
_SIDE = (
    ("<aside class='sidebar'><p>", "</p></aside>"), ("<div class='cookie-notice'>", "</div>"), ("<section id='comments'><p>", "</p></section>"),
    ("<form action='/s'><label>", "</label></form>"), ("<header class='site-header'><p>", "</p></header>"), ("<div class='ad banner'><p>", "</p></div>"),
    ("<div class='related'><ul><li><a href='/r'>", "</a></li></ul></div>"), ("<div class='share'><a href='/s'>", "</a></div>"),
    ("<div class='comment'><p>", "</p></div>"), ("<div class='newsletter-signup'><p>", "</p></div>"), ("<footer><p>", "</p></footer>"),
    ("<ul class='menu'><li><a href='/m'>", "</a></li></ul>"), ("<div role='alert' class='notice'><p>", "</p></div>"),
)
_MAIN = ("article", "main", "div class='content'", "div id='main'", "section class='post'", "div class='entry-content'", "div class='story-body'")


def variants(page: str, number: int) -> list[str]:
    """The page, and it rewritten: another container for its article, side matter of its own words in and around it."""
    pick = np.random.default_rng(number)
    out = [page]
    words = [b.text for b in blocks_of(page)] or ["text"]
    for _ in range(2):
        main = _MAIN[pick.integers(len(_MAIN))]
        text = re.sub(r"<article\b[^>]*>", f"<{main}>", page)
        text = text.replace("</article>", f"</{main.split()[0]}>")
        for at in ("</article>", f"</{main.split()[0]}>", f"<{main}>"):
            if at in text:
                begin, end = _SIDE[pick.integers(len(_SIDE))]
                words_here = words[pick.integers(len(words))].split()[: int(pick.integers(3, 40))]
                side = begin + entities.escape(" ".join(words_here)) + end
                before = at.startswith("</") and pick.random() < 0.5 or at.startswith("<") and not at.startswith("</")
                text = text.replace(at, side + at if before else at + side, 1)
        out.append(text)
    return out


def train(pages: DataFrame, sample: int = SAMPLE, key: str = "page_id") -> Field:
    """Fit on pages with the smallest hashes of their ids; blocks that the markup leaves open are not main text."""
    chosen = pages.select(F.col(key).alias("id"), "html").where(F.col("html").isNotNull())
    # Only the sample's pages reach the driver, as hashed features with labels.
    few = chosen.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)

    def made(batches):
        for batch in batches:
            rows = []
            for number, page in zip(batch["id"].to_pylist(), batch["html"].to_pylist(), strict=True):
                for variant in variants(page, zlib.crc32(str(number).encode())):
                    blocks = blocks_of(variant)
                    labels = [marked(b) for b in blocks]
                    if 1 in labels:
                        rows.append({"id": str(number), "rows": features(blocks), "labels": [x or 0 for x in labels]})
            yield pa.RecordBatch.from_pylist(
                rows, schema=pa.schema([("id", pa.string()), ("rows", pa.list_(pa.list_(pa.int32()))), ("labels", pa.list_(pa.int32()))])
            )

    found = chosen.join(F.broadcast(few), "id", "left_semi").mapInArrow(made, "id string, rows array<array<int>>, labels array<int>")
    table = found.toArrow().to_pylist()
    table.sort(key=lambda r: (r["id"], len(r["rows"]), str(r["labels"])))
    field = Field().fit([(r["rows"], r["labels"]) for r in table])
    if not table:
        # No page says anything: rely on names and links alone.
        for name, weight in (("side tag", -4), ("side name", -4), ("linked 4", -4), ("bias", 1)):
            field.w[_hash(name), 1] = weight
    return field


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page or "")
    labels = field.decode(features(blocks))
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, sample: int = SAMPLE, key: str = "page_id") -> tuple[DataFrame, str]:
    """Pages with their main text as one more column, whose name is returned too."""
    sent = pages.sparkSession.sparkContext.broadcast(train(pages, sample, key))
    name = unused("text", pages.columns)
    schema = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])

    def extracted(batches):
        for batch in batches:
            texts = [main_text(p, sent.value) for p in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return pages.mapInArrow(extracted, schema), name


def digest(found: DataFrame, name: str) -> DataFrame:
    text = F.col(name)
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
