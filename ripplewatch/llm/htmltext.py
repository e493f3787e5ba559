"""Main text of HTML pages by a linear-chain conditional random field over the leaf blocks of their DOM.

Each block is described by its ancestors (tags, and words of class, id and role), its own tag, and its text (length,
links, punctuation, place on the page). The field scores a label for every block and for every pair of neighbours;
training maximises the likelihood of labelled pages by forward and backward sums, and Viterbi finds the best labelling
of a page. Labelled pages are composed by rule from many layouts, so the model learns which containers hold an
article and which do not, alone and inside each other.
"""

import pickle
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplewatch.llm.dom import Block, leaf_blocks

#: Words that page authors put into class and id of containers of an article, and of anything else.
CONTENT_WORDS = "article content post entry story text body main prose copy page primary blog single detail".split()
OTHER_WORDS = {
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs links toc pagination pager skip".split(),
    "header": "header masthead banner topbar brand logo hero site".split(),
    "footer": "footer copyright legal bottom colophon foot".split(),
    "aside": "sidebar aside widget side rail secondary related recommended trending popular more".split(),
    "notice": "cookie consent notice alert popup modal gdpr warning overlay toast".split(),
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion promoted banner".split(),
    "form": "form newsletter subscribe signup login search contact".split(),
    "comments": "comment comments reply replies discussion respond disqus responses reader readers feedback".split(),
    "social": "share sharing social follow tags meta byline author date".split(),
}
_SECTIONS = frozenset("article main nav header footer aside form section figure table ul ol dialog".split())


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of what is true of each block."""
    out = []
    n = len(blocks)
    for k, b in enumerate(blocks):
        inner = b.tags[-1] if b.tags else "none"
        got = ["bias", f"own:{inner}"]
        seen = set()
        nearest = None
        for tag, words in zip(reversed(b.tags), reversed(b.words), strict=True):
            if tag in _SECTIONS:
                seen.add(f"in:{tag}")
                nearest = nearest or tag
            if words:
                seen.update(f"word:{w}" for w in words)
                if nearest is None or nearest == "word":
                    seen.update(f"near:{w}" for w in words)
                    nearest = nearest or "word"
        got += seen
        got.append(f"nearest:{nearest}")
        size = b.text.count(" ") + 1
        got.append("size:" + ("1" if size < 3 else "3" if size < 10 else "10" if size < 25 else "25"))
        got.append("links:" + ("all" if b.linked >= 0.8 * len(b.text) else "some" if b.linked else "none"))
        got.append("stop" if b.text[-1] in ".!?:;\"”»" else "nostop")
        if "©" in b.text:
            got.append("copyright")
        if b.hidden:
            got.append("hidden")
        if k == 0:
            got.append("first")
        if k == n - 1:
            got.append("last")
        out.append(got)
    return out


class Field:
    """Weights of features for label 1 (main text) and of neighbouring labels."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def scores(self, described: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in names) for names in described]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not blocks:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        scores = self.scores(features(blocks))
        zero, one, back = 0.0, scores[0], []
        for s in scores[1:]:
            from0, from1 = zero + p00 >= one + p10, zero + p01 >= one + p11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            zero, one = (zero + p00 if from0 else one + p10), (zero + p01 if from1 else one + p11) + s
        labels = [int(one > zero)]
        for to0, to1 in reversed(back):
            labels.append(to1 if labels[-1] else to0)
        return labels[::-1]


def train(pages: list[list[tuple[list[str], int]]], *, rounds: int = 150, penalty: float = 0.001) -> Field:
    """Fit the field to labelled pages: (feature names, label) of every block of a page.

    All pages are padded to one length and swept together; steps follow the sign of the gradient with adapting sizes.
    """
    names = {f: k for k, f in enumerate(sorted({f for page in pages for described, _ in page for f in described}))}
    longest, n = max(len(p) for p in pages), len(pages)
    x = np.zeros((n, longest, len(names)), np.float32)
    y = np.zeros((n, longest), np.int64)
    lengths = np.array([len(p) for p in pages])
    for i, page in enumerate(pages):
        for t, (described, label) in enumerate(page):
            y[i, t] = label
            x[i, t, [names[f] for f in described]] = 1
    inside = np.arange(longest)[None, :] < lengths[:, None]
    both = inside[:, 1:]
    seen = np.einsum("ntf,nt->f", x, y * inside)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    w, pairs = np.zeros(len(names)), np.zeros((2, 2))
    theta = np.zeros(len(names) + 4)
    step, last = np.full(len(theta), 0.1), np.zeros(len(theta))
    for _ in range(rounds):
        w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        s = np.zeros((n, longest, 2))
        s[:, :, 1] = x @ w.astype(np.float32)
        ahead, behind = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0]
        for t in range(1, longest):
            now = np.logaddexp.reduce(ahead[:, t - 1, :, None] + pairs, axis=1) + s[:, t]
            ahead[:, t] = np.where(inside[:, t, None], now, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            now = np.logaddexp.reduce(pairs + (s[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(inside[:, t + 1, None], now, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * inside
        joint = ahead[:, :-1, :, None] + pairs + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        joint = (np.exp(np.minimum(joint, 0)) * both[:, :, None, None]).sum(axis=(0, 1))
        gradient = np.r_[seen - np.einsum("ntf,nt->f", x, one), (seen_pairs - joint).ravel()] - penalty * n * theta / 10
        grew, fell = gradient * last > 0, gradient * last < 0
        step = np.clip(np.where(grew, step * 1.2, np.where(fell, step * 0.5, step)), 1e-4, 1.0)
        last = np.where(fell, 0, gradient)
        theta = theta + np.sign(last) * step
    w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
    return Field({f: float(w[k]) for f, k in names.items()}, pairs)


class _Composer:
    """Labelled pages composed by rule: an article in some container among other parts, some of them inside it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        make = lambda: "".join(self.r.choice("aeiou") + self.r.choice("bcdlmnrst") for _ in range(self.r.randint(1, 4)))
        return " ".join(make() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 60) -> str:
        high = self.r.choice([high, min(high, 6)])  # short ones are common, too
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def mark(self, text: str, label: int) -> str:
        """The label travels in the text itself, behind a sign no word contains."""
        return f"{text}\x01{label}"

    def attribute(self, words: list[str]) -> str:
        word = self.r.choice(words)
        name = self.r.choice([word, f"{word}-{self.r.choice(['box', 'wrap', 'inner', 'list', word])}", f"site-{word}"])
        return f' {self.r.choice(["class", "id"])}="{name}"'

    def paragraphs(self, n: int) -> str:
        out = []
        for _ in range(n):
            text = self.mark(self.sentence(), 1)
            kind = self.r.random()
            if kind < 0.6:
                out.append(f"<p>{text}</p>")
            elif kind < 0.7:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.76:
                out.append(f"<h2>{self.mark(self.words(1, 6), 1)}</h2>")
            elif kind < 0.82:
                items = "".join(f"<li>{self.mark(self.words(1, 15), 1)}</li>" for _ in range(self.r.randint(1, 4)))
                out.append(f"<{(t := self.r.choice(['ul', 'ol']))}>{items}</{t}>")
            elif kind < 0.88:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.93:
                out.append(f"<div>{text}</div>")
            elif kind < 0.96:
                out.append(f"<table><tr><td>{self.mark(self.words(1, 4), 1)}<td>{self.mark(self.words(1, 4), 1)}</table>")
            else:
                out.append(f'<p><a href="/x">{self.words(1, 3)}</a> {text}</p>')
        return "".join(out)

    def other(self, kind: str) -> str:
        """A part that is not main text, in its own element or in a container named for it."""
        named = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "notice": "dialog"}
        tag, attribute = "div", self.attribute(OTHER_WORDS[kind])
        if kind in named and self.r.random() < 0.5:
            tag, attribute = named[kind], self.r.choice(["", attribute])
        elif self.r.random() < 0.25:
            tag = self.r.choice(["section", "aside", "p", "ul"])
        inner = []
        for _ in range(self.r.randint(1, 4)):
            text = self.mark(self.sentence(1, 50 if kind in ("comments", "ad", "notice", "aside", "footer") else 6), 0)
            wrap = self.r.random()
            if kind == "nav" or wrap < 0.2:
                inner.append(f'<ul><li><a href="/y">{self.mark(self.words(1, 3), 0)}</a></li></ul>')
            elif kind == "form":
                inner.append(f"<label>{text}</label><input><button>{self.mark(self.words(1, 2), 0)}</button>")
            elif kind == "footer" and wrap < 0.6:
                inner.append(f"&copy; {text}")
            elif wrap < 0.6 and tag != "p":
                inner.append(f"<p>{text}</p>")
            elif wrap < 0.7 and tag != "p":
                inner.append(f"<h3>{self.mark(self.words(1, 4), 0)}</h3><p>{text}</p>")
            else:
                inner.append(text + "<br>")
                break
        return f"<{tag}{attribute}>{''.join(inner)}</{tag}>"

    def page(self) -> str:
        r = self.r
        parts = [self.other(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if r.random() < 0.45]
        r.shuffle(parts)
        body = [f"<h1>{self.mark(self.words(1, 9), 1)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 4)):
            body.append(self.paragraphs(r.randint(1, 5)))
            if r.random() < 0.3:
                body.append(self.other(r.choice(["ad", "social", "aside", "form", "comments", "notice"])))
        inner = "".join(body)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            inner = f"<div{self.attribute(CONTENT_WORDS) if r.random() < 0.8 else ''}>{inner}</div>"
        kind = r.random()
        if kind < 0.45:
            inner = f"<article>{inner}</article>"
        elif kind < 0.65:
            inner = f"<main{r.choice(['', self.attribute(CONTENT_WORDS)])}>{inner}</main>"
        elif kind < 0.9:
            inner = f"<div{self.attribute(CONTENT_WORDS)}>{inner}</div>"
        if r.random() < 0.2:
            inner = f"<main>{inner}</main>"
        after = [self.other(k) for k in ("comments", "aside", "social", "ad", "form") if r.random() < 0.4]
        r.shuffle(after)
        closing = [self.other("footer")] if r.random() < 0.8 else []
        return "<body>" + "".join([*parts, inner, *after, *closing])


def labelled_pages(n: int = 500, seed: int = 7) -> list[list[tuple[list[str], int]]]:
    """``n`` composed pages as (features, label) of their blocks."""
    composer, out = _Composer(seed), []
    for _ in range(n):
        blocks = leaf_blocks(composer.page())
        labels = [int(b.text.rpartition("\x01")[2].strip()[:1] or 0) for b in blocks]
        for b in blocks:
            b.text = "".join(x[1:] if k else x for k, x in enumerate(b.text.split("\x01"))).strip() or "."
        if blocks:
            out.append(list(zip(features(blocks), labels, strict=True)))
    return out


_trained: dict = {}


def default_field() -> Field:
    """The field trained on the composed pages; trained once in a process."""
    if "field" not in _trained:
        _trained["field"] = train(labelled_pages())
    return _trained["field"]


def main_text(page: str | None, field: Field) -> str:
    """The main text of a page: its blocks joined by line ends; empty if there is none."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, field.decode(blocks), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    A null or empty html, or one without text, has the empty text. Repeated rows stay repeated, null ids and urls stay
    null; other columns are ignored; an empty table gives an empty result.
    """
    packed = pages.sparkSession.sparkContext.broadcast(pickle.dumps(field or default_field()))  # a few hundred weights
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def run(batches):
        own = pickle.loads(packed.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [main_text(h, own) for h in part.column(2).to_pylist()]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), sizes]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
