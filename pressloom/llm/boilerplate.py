"""The main text of web pages by maximum-scoring stretches of their words and tags (problem 5).

A page is read as one sequence of tokens: for every line its tag (with the shape of the line and where it stands) and then its words and
signs. Each token has a weight, fitted to labelled pages: words of articles weigh positive, tags and words of page furniture negative.
A linear scan finds the stretches of the sequence with the largest sum of weights, where every break costs as much as `Spec.cost`: so an
article is one stretch unless what parts it is a block of furniture that weighs more than the breaks, and a single article-like line
among menus isn't a stretch. The lines of the stretches are the article; no line is judged by itself.

The weights are the log-odds of a logistic regression over hashed tokens, fitted to pages whose own class names tell what a line is, and
a short list of lines labelled by hand. Two sets are fitted, with and without tags, as some bodies are plain text. The sample of labelled
pages is bounded by `Spec.pages`; the scan covers every page and every word. Batches of pages are scanned in lockstep.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm import flat

#: Class names that tell what a line is (fixed values).
ARTICLE = {"article-text", "article-body", "article", "story-body", "entry-content", "post-content"}
FURNITURE = {
    "menu", "nav", "navigation", "sidebar", "footer", "header", "headline", "meta", "byline", "breadcrumb", "widget", "promo", "consent", "cookie",
    "author", "reader", "comment", "comments", "inline-link", "related", "caption", "advert", "ad", "share", "social", "newsletter",
}

#: Lines labelled by hand, beside the labelled pages.
NO = """Accept all cookies | Settings
We use cookies and similar tools to improve this site.
This site uses cookies to measure audience and show advertising. Accept all | Manage settings
We and our 12 partners store and access information on your device. You can change your choice at any time.
Share · Copy link · Print
Share this article
Advertisement
ADVERTISEMENT
Article continues below
Listen to this article (3 min)
Photo: Jane Doe / Agency
Image: John Doe
Read also: Council approves new budget
Read the full story on example.org
Related stories
Most read
Trending now
You may also like
More from the region
Elsewhere on the web
Editor’s picks
3 comments
Comment removed by moderator
Great piece! I agree.
Sorry, but nobody believes this. Where is the money now?
Does anyone know if this is still true?
© 2026 The Gazette. All rights reserved.
Terms of use | Privacy | Accessibility | Contact us
About us · Advertise with us · Corrections · Careers
Home | World | Politics | Business | Sport | Culture
Home · Local · Weather · Travel · Jobs · Opinion
Home > Politics
Back to top ↑
Download our app · Follow us on social media
Sign up for our morning newsletter.
Support independent reporting: become a member from 5 a month.
Already a subscriber? Log in to read without adverts.
Registered office: 1 High Street, London. No part of this site may be reproduced without permission.
By Jane Doe
By Jane Doe, London
Published 1.06.2026 · Updated 2 hours ago
12 May 2026, 10:45
London 12°C
Jane Doe is a freelance reporter based in London. Contact the newsroom with tips.
This column reflects the views of Jane Doe, who sits on the advisory board of the bank.
The Gazette is a member of the press council and follows its code of practice.
window.dataLayer = window.dataLayer || [];
var slot_12 = {size: [300, 250], targeting: "news"};
!function(){document.documentElement.className += " js"}();
.c123 { display: none; }
{"@type": "NewsArticle", "position": 12}
adqueue.push(123);
Teilen · Drucken
Anzeige
Mehr zum Thema
Meistgelesen
Impressum | Datenschutz | Kontakt
Alle Rechte vorbehalten.
Foto: Anna Schmidt
Newsletter abonnieren
Wir verwenden Cookies und ähnliche Technik. Alle akzeptieren | Einstellungen
Lesen Sie auch: Rat stimmt Haushalt zu
Compartir · Imprimir
Lo más leído
Noticias relacionadas
Todos los derechos reservados.
Aviso legal | Privacidad | Contacto
Quiénes somos · Publicidad · Suscripciones
Suscríbase al boletín
Usamos cookies propias y de terceros. Aceptar | Configurar
Partager · Imprimer
Les plus lus
À lire aussi
Tous droits réservés.
Mentions légales | Confidentialité | Contact
Qui sommes-nous · Publicité · Abonnements
Inscrivez-vous à la lettre
Nous utilisons des cookies. Tout accepter | Paramétrer
Leia também
Mais lidas
Todos os direitos reservados.
Assine a newsletter""".split("\n")
YES = """They waited.
It rained.
Nothing came.
“No.”
“Not yet,” they said.
Then the lights went out.
What happens next
Who pays?
A long dispute
Back to court
Numbers in doubt
Costs and promises
Terms of the deal
‘Nobody asked us’
Sign up or stay out
The council approved the budget on Monday after a long debate, a spokesperson said.
Officials blamed rising costs for the delay, which could last until autumn.
“This is no excuse,” the mayor said on Tuesday.
About 1,200 people gathered to protest against the plan.
• 120 families moved from the old town to the harbour;
• £3.4 million for schools in the region;
• No decision before the summer, the court says.
A new bridge, approved last week;
The newsletter of the union had 1,200 subscribers when the plan was published, a filing shows.
Readers were asked to accept cookies before seeing the report, a lawyer told the hearing.
“All rights reserved” was printed on the draft, she said, and nobody read further.
Der Stadtrat stimmte am Montag nach langer Debatte dem Haushalt zu.
„Das ist keine Entschuldigung“, sagte die Bürgermeisterin am Dienstag.
Wie es weitergeht
Zahlen und Zweifel
Streit ums Geld
El ayuntamiento aprobó el lunes el presupuesto, según el alcalde.
Qué pasa ahora
Quién paga
Una larga disputa
Le conseil a approuvé lundi le budget après un long débat.
Et maintenant ?
Qui paiera ?
Un long conflit
A câmara aprovou na segunda-feira o orçamento, segundo o autarca.""".split("\n")


@dataclass(frozen=True)
class Spec:
    """pages: most labelled pages to learn from; bits: hashed weights; clip: most a line adds to or takes from a stretch; cost: what the
    start of a stretch and its end cost each."""

    pages: int = 1500
    bits: int = 18
    epochs: int = 20
    batches: int = 16
    rate: float = 0.15
    decay: float = 2e-5
    clip: float = 6.0
    cost: float = 0.7
    seed: int = 5


_TAG = re.compile(r"\s*<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>")
_ANYTAG = re.compile(r"<[^>]*>")
_CLASS = re.compile(r"class\s*=\s*[\"']([^\"']*)[\"']")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def split_line(line: str) -> tuple[str, str, str]:
    """(tag, class, text) of a line; tag is empty for plain text."""
    if "<" not in line:
        return "", "", (html.unescape(line) if "&" in line else line).strip()
    m = _TAG.match(line)
    c = _CLASS.search(m.group(2)) if m else None
    text = _ANYTAG.sub("", line)
    return m.group(1).lower() if m else "", c.group(1).strip() if c else "", (html.unescape(text) if "&" in text else text).strip()


def label(cls: str) -> int:
    """1 article, 0 furniture, -1 unknown."""
    names = set(cls.lower().split())
    return 1 if names & ARTICLE else 0 if names & FURNITURE else -1


@dataclass
class Lines:
    """The non-blank lines of a batch of pages: the page, number, tag, class and text of each."""

    page: list[int] = field(default_factory=list)
    number: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    cls: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    titled: list[bool] = field(default_factory=list)

    def add(self, page: int, title: str | None, body: str | None) -> None:
        name = " ".join((title or "").split()).casefold()
        for i, line in enumerate((body or "").split("\n"), 1):
            if line and not line.isspace():
                tag, cls, text = split_line(line)
                self.page.append(page)
                self.number.append(i)
                self.tag.append(tag)
                self.cls.append(cls)
                self.text.append(text)
                self.titled.append(bool(name) and abs(len(text) - len(name)) < 8 and " ".join(text.split()).casefold() == name)


# --- tokens and their features ------------------------------------------------------------------------------------------------------

NUMBER, CAPITAL, NONE = (np.uint64(x) for x in (0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0x8CB92BA72F3D8DD7))


def _salted(kind: int, *parts) -> np.ndarray:
    """A hash of the parts under a kind of feature."""
    h = np.full(1, kind * 2 + 1, np.uint64)
    for p in parts:
        h = flat.mix(np.asarray(p).astype(np.uint64) + h * np.uint64(flat.BASE))
    return h


def _words_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(hash of each token, its line, figures per line). Numbers are one token, and so are capitalized words that don't begin a line."""
    cls_of, low_of = flat.char_tables()
    cp = np.frombuffer(("\n".join(t.replace("\n", " ") for t in texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    small = np.minimum(cp, 0xFFFF)
    low = low_of[small]
    kind = np.array([3, 0, 2, 1, 1, 1], np.uint8)[cls_of[small]]  # letters 1, digits 2, space 0, signs 3
    kind[cp >= 0x20000] = 1
    before, after = np.r_[kind[:1], kind[:-1]], np.r_[kind[1:], kind[-1:]]
    kind[((cp == 39) | (cp == 0x2019)) & (before == 1) & (after == 1)] = 1
    kind[((cp == 44) | (cp == 46) | (cp == 58)) & (before == 2) & (after == 2)] = 2
    newline = cp == 10
    end = np.flatnonzero(newline)
    begin = np.r_[0, end[:-1] + 1]
    edge = np.r_[True, kind[1:] != kind[:-1]] | (kind == 3)
    start = np.flatnonzero(edge & (kind != 0))
    # a token ends where the next edge is
    edges = np.r_[np.flatnonzero(edge), len(cp)]
    stop = edges[np.searchsorted(edges, start, "right")]
    line = np.searchsorted(end, start)
    h = flat.span_hash(low + np.uint32(1), start, stop)
    h[kind[start] == 2] = NUMBER
    n = np.bincount(line, minlength=len(texts))
    first = np.cumsum(n) - n
    inner = np.ones(len(h), bool)
    inner[first[n > 0]] = False
    h[inner & (cls_of[small[start]] == 4)] = CAPITAL
    total = lambda m: np.diff(np.r_[0, np.cumsum(m)][np.r_[begin, end[-1] + 1]]) if len(end) else np.zeros(0, np.int64)
    spaced = np.r_[False, (cp[:-2] == 32) & np.isin(cp[1:-1], (124, 0xB7, 62)) & (cp[2:] == 32), False] if len(cp) > 2 else np.zeros(len(cp), bool)
    one = lambda at: cp[np.clip(at, 0, max(0, len(cp) - 1))]
    last, head = one(end - 1), one(begin)
    lettered = np.isin(cls_of[np.minimum(last, 0xFFFF)], (2, 3, 4, 5))
    alpha = lettered & (cls_of[np.minimum(last, 0xFFFF)] > 2)
    opens = total(np.isin(cp, [ord(c) for c in "=({"])) > 0
    code = opens & (total(np.isin(cp, [ord(c) for c in "{}[]()"])) > 0) & (np.isin(head, [ord(c) for c in "{}.!"]) | np.isin(last, [ord(c) for c in ";})"]))
    return h, line, {"n": n, "first": first, "separators": np.minimum(total(spaced), 3), "end": np.where(lettered, 97, last), "alpha": alpha, "code": code}


def features(x: Lines, bits: int, tags: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(line, place) of the features of words, and a matrix of those of tags, a row per line, whose first columns need no neighbours."""
    h, line, s = _words_of(x.text)
    n, first, m = s["n"], s["first"], len(x.text)
    mask = np.uint64((1 << bits) - 1)
    at = lambda k: h[np.clip(first + k, 0, max(0, len(h) - 1))] if len(h) else np.zeros(m, np.uint64)
    nth = lambda k: np.where(n > k, at(k), NONE)
    back = lambda k: np.where(n > k, at(n - 1 - k), NONE)
    pair = np.flatnonzero(line[1:] == line[:-1])
    places = np.r_[_salted(1, h), _salted(2, h[:-1][pair], h[1:][pair])] & mask
    lines = np.r_[line, line[1:][pair]]
    tag = _named(x.tag) if tags else np.zeros(m, np.uint64)
    size = np.where(n < 4, n, np.digitize(n, (8, 16, 40)) + 4)
    whole = np.where(n <= 12, flat.span_hash(h, first, first + n), NONE) if len(h) else np.full(m, NONE)
    end, sep = s["end"], s["separators"]
    two = _salted(3, nth(0), nth(1))
    three = _salted(4, back(0), back(1), back(2))
    own = [_salted(5, whole), two, three, _salted(6, end), _salted(7, sep), _salted(8, s["code"])]
    page = np.array(x.page, np.int64)
    same_up = np.r_[False, page[1:] == page[:-1]]
    same_down = np.r_[same_up[1:], False]
    up = lambda v, d: np.where(same_up, np.r_[v[:1], v[:-1]], np.uint64(d))
    down = lambda v, d: np.where(same_down, np.r_[v[1:], v[-1:]], np.uint64(d))
    shape = _salted(9, tag, end, size)
    rank = np.arange(m) - np.maximum.accumulate(np.where(same_up, 0, np.arange(m)))
    togo = (np.minimum.accumulate(np.where(same_down, m, np.arange(m))[::-1])[::-1] - np.arange(m)) if m else rank
    near = lambda v: np.where(v < 4, v, np.digitize(v, (8, 16, 40)) + 4)
    heading = np.array([tags and t in HEADINGS for t in x.tag], bool) | (n <= 5) & s["alpha"]
    above = np.maximum.accumulate(np.where(heading, np.arange(m), -1))
    above = np.r_[-1, above[:-1]] if m else above
    known = (above >= 0) & (page[np.maximum(above, 0)] == page)
    title = np.where(known, _salted(10, nth(0), nth(1), nth(2), nth(3), nth(4))[np.maximum(above, 0)], NONE) if m else np.zeros(0, np.uint64)
    since = np.where(known, np.arange(m) - above, rank)
    look = _salted(11, tag, _named(x.cls)) if tags else np.zeros(m, np.uint64)
    like = (up(look, 0) == look) * 2 + (down(look, 0) == look) if tags else np.zeros(m, np.int64)
    placed = [
        _salted(12, tag), _salted(13, size), shape, _salted(14, tag, end, sep), _salted(15, x.titled), _salted(16, up(shape, 1)), _salted(17, down(shape, 2)), _salted(18, up(two, 1)), _salted(19, down(two, 2)),
        _salted(20, up(size.astype(np.uint64), 9), up(end.astype(np.uint64), 9), size, end, down(size.astype(np.uint64), 9), down(end.astype(np.uint64), 9)),
        _salted(21, near(rank)), _salted(22, near(togo)), _salted(23, title), _salted(24, title, np.minimum(since, 6), size, end), _salted(25, like, tag), _salted(26, np.zeros(m)),
    ]
    return lines, places.astype(np.int64), (np.column_stack([*own, *placed]) & mask).astype(np.int64), len(own)


def _named(words: Sequence[str]) -> np.ndarray:
    """A hash of each of some short strings, most of them the same."""
    every = sorted(set(words))
    code = {w: i for i, w in enumerate(every)}
    return flat.span_hash(*_codes(every))[np.array([code[w] for w in words], np.int64)] if every else np.zeros(0, np.uint64)


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cp = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32) + np.uint32(1)
    n = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(n)
    return cp, end - n, end


# --- weights ------------------------------------------------------------------------------------------------------------------------


def fit(rows: np.ndarray, places: np.ndarray, y: np.ndarray, spec: Spec) -> np.ndarray:
    """Logistic regression over hashed features, (row, place) sorted by row, by Adagrad over a few batches; classes weigh alike."""
    w = np.zeros(1 << spec.bits)
    if not len(y) or not (0 < y.sum() < len(y)):
        return w.astype(np.float32)
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    g2 = np.full(len(w), 1e-6)
    # rows are dealt to batches by a hash, the same on every run
    part = (flat.mix(np.arange(len(y)).astype(np.uint64)) % np.uint64(spec.batches)).astype(np.int64)
    of = part[rows]
    sets = []
    for b in range(spec.batches):
        mine = np.flatnonzero(of == b)
        ids, local = np.unique(rows[mine], return_inverse=True)
        sets.append((ids, local, places[mine]))
    for _ in range(spec.epochs):
        for ids, local, idx in sets:
            if not len(ids):
                continue
            z = np.bincount(local, w[idx], len(ids))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = np.bincount(idx, ((p - y[ids]) * cost[ids])[local], len(w)) / len(ids) + spec.decay * w
            g2 += g * g
            w -= spec.rate * g / np.sqrt(g2)
    return w.astype(np.float32)


def learn(pages: Sequence[tuple[str, str]], spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Weights with and without tags from (title, body) of labelled pages."""
    x = Lines()
    for i, (title, body) in enumerate(pages):
        x.add(i, title, body)
    seeds = Lines()
    for i, t in enumerate([*NO, *YES] * 2):
        seeds.add(i, None, t)
    told = np.array([label(c) for c in x.cls], np.int64) if x.cls else np.zeros(0, np.int64)
    hand = np.array([k for k, ls in ((0, NO), (1, YES)) for _ in ls] * 2)
    models = []
    for tags in (True, False):
        rows, places, y, base = [], [], [], 0
        # a line labelled by hand has no neighbours: only its own features count
        for part, label_, own_only in ((x, told, False), (seeds, hand, True)):
            if not part.text:
                continue
            ln, at, grid, own = features(part, spec.bits, tags)
            grid = grid[:, :own] if own_only else grid
            keep = label_ >= 0
            new = np.cumsum(keep) - 1 + base
            ln, at = np.r_[ln, np.repeat(np.arange(len(grid)), grid.shape[1])], np.r_[at, grid.ravel()]
            ok = keep[ln]
            rows.append(new[ln[ok]])
            places.append(at[ok])
            y.append(label_[keep])
            base += int(keep.sum())
        rows_, places_ = np.concatenate(rows), np.concatenate(places)
        order = np.argsort(rows_, kind="stable")
        models.append(fit(rows_[order], places_[order], np.concatenate(y).astype(float), spec))
    return models[0], models[1]


# --- the scan -----------------------------------------------------------------------------------------------------------------------


def stretches(page: np.ndarray, score: np.ndarray, cost: float) -> np.ndarray:
    """Lines in the set of stretches with the largest sum of scores less `cost` for every start and end, for all pages at once.

    page: the page of each line, pages in a row. One pass forward and one back: step t takes the t-th line of every page that has one.
    """
    m = len(score)
    keep = np.zeros(m, bool)
    if not m:
        return keep
    head = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    size = np.diff(np.r_[head, m])
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    # best sums with the line just read inside and outside; whether they stay on the side they were on
    inside, outside = np.full(len(head), -np.inf), np.zeros(len(head))
    stay_in, stay_out = np.zeros(m, bool), np.zeros(m, bool)
    for t in range(size[0]):
        k, at = live[t], head[: live[t]] + t
        a, b = inside[:k], outside[:k]
        stay_in[at], stay_out[at] = a >= b - cost, b >= a - cost
        inside[:k], outside[:k] = np.maximum(a, b - cost) + score[at], np.maximum(b, a - cost)
    now = np.zeros(len(head), bool)
    for t in range(size[0] - 1, -1, -1):
        k, at = live[t], head[: live[t]] + t
        last = size[:k] == t + 1
        # the end of the page ends a stretch for nothing
        now[:k] = np.where(last, inside[:k] > outside[:k], now[:k])
        keep[at] = now[:k]
        now[:k] = np.where(now[:k], stay_in[at], ~stay_out[at])
    return keep


def scores(x: Lines, models: tuple[np.ndarray, np.ndarray], spec: Spec) -> np.ndarray:
    """The sum of the weights of each line's tag and words; pages of which most lines have no tag are read as plain text."""
    page = np.array(x.page, np.int64)
    tagged = np.array([bool(t) for t in x.tag])
    some = np.bincount(page, tagged) * 2 > np.bincount(page) if len(page) else np.zeros(0, bool)
    total = np.zeros(len(page))
    for tags, w in zip((True, False), models):
        mine = np.flatnonzero(some[page] == tags) if len(page) else page
        if len(mine):
            part = Lines(*([v[i] for i in mine] for v in (x.page, x.number, x.tag, x.cls, x.text, x.titled)))
            ln, at, grid, _ = features(part, spec.bits, tags)
            total[mine] = np.bincount(ln, w[at], len(mine)) + w[grid].sum(1)
    return np.clip(total, -spec.clip, spec.clip)


def article_lines(pages: Sequence[tuple[str | None, str | None, str | None]], models: tuple[np.ndarray, np.ndarray], spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(page, line number) of the article's lines. pages: title, body, method; an abstract is an article as a whole."""
    x = Lines()
    for i, (title, body, _) in enumerate(pages):
        x.add(i, title, body)
    page, number = np.array(x.page, np.int64), np.array(x.number, np.int64)
    whole = np.array([m == "abstract" for _, _, m in pages], bool)
    keep = stretches(page, scores(x, models, spec), spec.cost)
    keep |= whole[page] if len(page) else False
    return page[keep], number[keep]


def labelled_pages(df: DataFrame, spec: Spec) -> list[tuple[str, str]]:
    """At most spec.pages pages with telling class names, the same ones on every run."""
    names = "|".join(sorted(ARTICLE))
    some = df.filter(F.col("body").rlike(rf"class=\"({names})\""))
    rows = some.select("title", "body").orderBy(F.xxhash64("item_id", F.lit(spec.seed)), "item_id").limit(spec.pages).collect()
    return [(r["title"] or "", r["body"]) for r in rows]


def main_lines(df: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """df: item_id, title, body, method. item_id, line_no of each line of the article itself.

    Repeated rows count once (should an item have several bodies, the lines of each); a null body has no lines; a null id is left out.
    """
    src = df.select(F.col("item_id").cast("long").alias("item_id"), "title", "body", "method").filter("item_id IS NOT NULL AND body IS NOT NULL")
    models = learn(labelled_pages(src, spec), spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for s, e, part in flat.text_pieces(b.column(2)):
                page, number = article_lines(list(zip(b.column(1).slice(s, e - s).to_pylist(), part.to_pylist(), b.column(3).slice(s, e - s).to_pylist())), models, spec)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s + page]), pa.array(number.astype(np.int32))], ["item_id", "line_no"])

    return src.mapInArrow(run, "item_id long, line_no int").distinct()


def main_text(df: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """item_id, lines, text: the article's lines without tags, in order, one per line."""
    numbered = df.filter("item_id IS NOT NULL AND body IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.posexplode(F.split("body", "\n", -1)).alias("i", "line"))
    numbered = numbered.select("item_id", (F.col("i") + 1).alias("line_no"), "line").distinct()
    plain = F.trim(F.regexp_replace("line", "<[^>]*>", ""))
    kept = numbered.join(main_lines(df, spec), ["item_id", "line_no"]).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("line_no", plain.alias("t")))).alias("x"))
    return kept.select("item_id", F.size("x").alias("lines"), F.concat_ws("\n", "x.t").alias("text"))
