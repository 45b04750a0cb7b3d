"""Text quality figures per document from a hidden Markov model over its lines (problem 8).

Each non-blank line gets counts (letters, digits, signs, words, common words, separators, repeated words and lines, how it begins and ends,
how it continues its neighbours), which become classes of values. States are prose, list, table and junk. The emission of a state is the
posterior of a softmax regression over these classes, divided by the state's share in training; transitions are fitted by expectation and
maximization over the labelled documents, kinds counting alike; a text may begin in any state, so that a text of one line is judged by
that line. The best path of states labels the lines, and the share of a document's characters in each state tells prose from the rest.

The model is fitted on a bounded sample of hand-labelled documents, as many of each kind, and a few lines written or made by rule here.
A document's label is one for the whole text, and some are wrong: in rounds, lines are relabelled by the model, where a document's own
kind and prose are likely and others are not. Everything else covers all documents and whole texts.

Characters are compared by code point; a null text is blank. A blank text, or one without a letter or digit, is no prose.
"""

from __future__ import annotations

import textwrap
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm import flat

KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)

#: Common words of English, German, French, Spanish and Portuguese (fixed values).
COMMON = """the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your
which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been
its who now people my made over did down only way find use may long little very after called just where most know
der die das und ist nicht ein eine zu den von mit dem des auf für im sich auch als an es bei nach aus wird werden noch oder aber wie wegen zum zur sagte hat haben sind
le la les de des et un une du est pas que qui dans pour sur au aux par plus avec ce ses son sa ont été elle il en se ne
el los las y que del por con una se lo su para al como más fue está pero sus ha según este
o os as e do da dos das em um uma não para com no na se por mais que foi ao""".split()

WORDS_LOW = (0, 1, 2, 3, 5, 8, 12, 16, 25, 40, 80)
SHARES = (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95)


@dataclass(frozen=True)
class Spec:
    """per_kind: most labelled documents of each kind to learn from; turns: rounds of expectation and maximization; pseudo: times each
    transition counts as seen beforehand."""

    per_kind: int = 250
    rounds: int = 2
    steps: int = 100
    turns: int = 5
    pseudo: float = 60.0
    seed: int = 3


def _word_hash(words: Sequence[str]) -> np.ndarray:
    cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    n = np.array([len(w) for w in words])
    end = np.cumsum(n)
    return np.unique(flat.span_hash(cp, end - n, end))


@lru_cache(1)
def _common() -> np.ndarray:
    return _word_hash(sorted(set(COMMON)))


STATS = ("chars", "letters", "capitals", "digits", "signs", "words", "wordchars", "single", "longest", "common", "initial", "tabs", "bars", "semis", "commas", "gaps", "stops", "code", "vowels", "same", "distinct", "pairs", "numbers", "first", "last", "blank_before", "blank_after")


def line_stats(texts: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(document of each non-blank line, its statistics)."""
    cls_of, low_of = flat.char_tables()
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    small = np.minimum(cp, 0xFFFF)
    cls = cls_of[small]
    cls[cp >= 0x20000] = 5
    newline = cp == 10
    end = np.flatnonzero(newline)
    start = np.r_[0, end[:-1] + 1]
    nlines = len(end)
    doc_end = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(doc_end, start, "right")

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[end] - total[start]).astype(np.int64)

    space, letter = cls == 1, cls >= 3
    solid = ~space
    filled = per_line(solid) > 0
    # first and last solid character of each line
    where = np.flatnonzero(solid)
    a = np.searchsorted(where, start)
    z = np.searchsorted(where, end) - 1
    if len(where):
        first_at, last_at = where[np.minimum(a, len(where) - 1)], where[np.maximum(z, 0)]
    else:
        first_at = last_at = np.zeros(nlines, np.int64)
    s: dict[str, np.ndarray] = {}
    s["chars"] = np.where(filled, last_at - first_at + 1, 0)
    s["letters"], s["capitals"], s["digits"], s["signs"] = per_line(letter), per_line(cls == 4), per_line(cls == 2), per_line(cls == 0)
    before = np.r_[False, letter[:-1]]
    ws, we = np.flatnonzero(letter & ~before), np.flatnonzero(before & ~letter)
    line_of = np.searchsorted(end, ws)
    n = we - ws
    count = lambda w=None: np.bincount(line_of, w, nlines)
    s["words"], s["wordchars"], s["single"] = count().astype(np.int64), count(n), count(n == 1)
    s["longest"] = np.zeros(nlines)
    np.maximum.at(s["longest"], line_of, n)
    low = low_of[small]
    h = flat.span_hash(low, ws, we)
    common = _common()
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    s["common"] = count(common[at] == h)
    s["initial"] = count(cls[ws] == 4)
    s["tabs"], s["bars"], s["semis"], s["commas"] = per_line(cp == 9), per_line(cp == 124), per_line(cp == 59), per_line(cp == 44)
    after = lambda m: np.r_[m[1:], False]
    s["gaps"] = per_line((cp == 32) & after(cp == 32) & ~np.r_[False, (cp == 32)[:-1]])
    s["stops"] = per_line(((cp == 46) | (cp == 33) | (cp == 63)) & after(cp == 32))
    s["code"] = per_line(np.isin(small, np.array([ord(c) for c in "{}[]<>=_%#^~*\\/+@$&"], np.uint32)))
    s["vowels"] = per_line(np.isin(low, np.array([ord(c) for c in "aeiouyáéíóúàèìòùâêîôûäëïöüãõåæøœ"], np.uint32)))
    s["numbers"] = per_line((cls == 2) & ~np.r_[False, (cls == 2)[:-1]])

    def distinct(key: np.ndarray, of: np.ndarray) -> np.ndarray:
        k = np.unique(flat.mix(key ^ (of.astype(np.uint64) * np.uint64(flat.BASE2))), return_index=True)[1]
        return np.bincount(of[k], None, nlines)

    s["distinct"] = distinct(h, line_of) if len(h) else np.zeros(nlines)
    if len(h) > 1:
        inside = line_of[1:] == line_of[:-1]
        s["pairs"] = np.bincount(line_of[:-1][inside], None, nlines) - distinct((h[:-1] * np.uint64(3) + h[1:])[inside], line_of[:-1][inside])
    else:
        s["pairs"] = np.zeros(nlines)
    lh = flat.span_hash(low, first_at, last_at + 1)
    key = flat.mix(lh ^ (doc.astype(np.uint64) * np.uint64(flat.BASE2)))
    key[~filled] = 0
    _, inv, times = np.unique(key, return_inverse=True, return_counts=True)
    s["same"] = times[inv]
    s["first"], s["last"] = _edge(cp, cls, first_at, True), _edge(cp, cls, last_at, False)
    gap = np.r_[np.flatnonzero(space), len(cp)]
    s["head"] = gap[np.searchsorted(gap, first_at)] - first_at
    blank = ~filled
    newdoc = np.r_[True, doc[1:] != doc[:-1]]
    s["blank_before"] = np.r_[True, blank[:-1]] | newdoc
    s["blank_after"] = np.r_[blank[1:], True] | np.r_[newdoc[1:], True]
    return doc[filled], {k: v[filled] for k, v in s.items()}


def _edge(cp: np.ndarray, cls: np.ndarray, at: np.ndarray, first: bool) -> np.ndarray:
    """Kind of the first or last character: 0 small letter, 1 capital, 2 digit, 3 full stop, 4 quotation mark, 5 bullet, 6 comma or colon, 7 other, 8 other letter."""
    out = np.full(len(at), 7)
    if not len(cp):
        return out
    c, k = cp[at], cls[at]
    out[k == 3], out[k == 4], out[k == 2], out[k == 5] = 0, 1, 2, 8
    is_in = lambda s: np.isin(c, np.array([ord(x) for x in s], np.uint32))
    out[is_in(".!?…。")] = 3
    out[is_in("\"'“”„‘’«»")] = 4
    out[is_in("-–—•*·▪●◦‣+") & first] = 5
    out[is_in(",:;")] = 6
    return out


def features(doc: np.ndarray, s: dict[str, np.ndarray]) -> np.ndarray:
    """Indexes into the weights, one row per line; every column has its own range."""
    n = len(doc)
    one = np.maximum(1, s["chars"])
    wd = np.maximum(1, s["words"])
    let = np.maximum(1, s["letters"])
    share = lambda x, y: np.digitize(x / y, SHARES)
    caps = s["capitals"] / let > 0.8
    same_prev = np.r_[False, doc[1:] == doc[:-1]] if n else np.zeros(0, bool)
    prev = lambda v, d: np.where(same_prev, np.r_[v[:1], v[:-1]], d) if n else v
    nxt_same = np.r_[same_prev[1:], False] if n else same_prev
    nxt = lambda v, d: np.where(nxt_same, np.r_[v[1:], v[-1:]], d) if n else v
    words = np.digitize(s["words"], WORDS_LOW)
    sep = np.minimum(3, s["tabs"]) + 4 * np.minimum(3, s["bars"]) if n else words
    first, last = s["first"], s["last"]
    # in wrapped text the next line's first word would not have fitted on the line
    widest = np.zeros(int(doc[-1]) + 1 if n else 0)
    np.maximum.at(widest, doc, s["chars"])
    wide = widest[doc]
    fits = np.where(nxt_same & (s["blank_after"] == 0), np.where(s["chars"] + 1 + nxt(s["head"], 0) <= wide, 1, 2), 0)
    fits = np.where(wide <= 100, fits, 3)
    fits_before = prev(fits, 0)
    stops = np.minimum(3, s["stops"])
    cols = [
        (words, 12), (share(s["letters"], one), 14), (share(s["digits"], one), 14), (share(s["signs"], one), 14),
        (np.where(caps, 13, share(s["initial"], wd)), 14), (np.where(caps, 1, 0), 2), (share(s["common"], wd), 14), (share(s["single"], wd), 14),
        (np.digitize(s["wordchars"] / wd, (0.5, 1.5, 2.5, 3.5, 4.2, 5, 6, 7, 8.5, 11, 15)), 12), (np.digitize(s["longest"], (1, 3, 6, 10, 14, 18, 24, 40)), 9),
        (sep, 16), (np.digitize(s["semis"], (1, 2, 3, 4)), 5), (share(s["commas"], wd + s["numbers"]), 14), (np.digitize(s["gaps"], (1, 2, 3, 5, 10)), 6),
        (stops, 4), (share(s["code"], one), 14), (share(s["vowels"], let), 14), (np.minimum(3, s["same"]), 4),
        (np.where(s["words"] > 5, share(s["distinct"], wd), 13), 14), (np.where(s["words"] > 5, share(s["pairs"], wd), 13), 14), (share(s["numbers"], wd + s["numbers"]), 14),
        (first, 9), (last, 9), (first * 9 + last, 81), (np.digitize(s["chars"], (2, 4, 20, 40, 60, 72, 90, 130, 200, 400)), 11),
        (prev(last, 9), 10), (nxt(first, 9), 10), (prev(last, 9) * 10 + first, 100), (last * 10 + nxt(first, 9), 100), (prev(first, 9) * 10 + first, 100),
        (s["blank_before"] * 2 + s["blank_after"], 4), (words * 9 + last, 108), (stops * 9 + last, 36), (words * 4 + stops, 48),
        (np.where(caps, 13, share(s["initial"], wd)) * 14 + share(s["common"], wd), 196), (prev(words, 12), 13), (nxt(words, 12), 13),
        (fits * 4 + fits_before, 16), (np.digitize(s["chars"] / np.maximum(1, wide), (0.3, 0.5, 0.7, 0.8, 0.87, 0.93, 0.999)) * 2 + (wide <= 100), 16),
    ]
    base = np.r_[0, np.cumsum([k for _, k in cols])]
    return np.column_stack([np.clip(c, 0, k - 1) + b for (c, k), b in zip(cols, base)]).astype(np.int32) if n else np.zeros((0, len(cols)), np.int32)


WIDTH = 1400


@dataclass
class Model:
    weights: np.ndarray
    step: np.ndarray
    begin: np.ndarray


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def emission(m: Model, f: np.ndarray) -> np.ndarray:
    """Log of the posterior by the (even) share of the states in training; bounded, so that no single line outweighs all others."""
    z = np.zeros((len(f), 4), np.float32)
    for j in range(f.shape[1]):
        z += m.weights[f[:, j]]
    return np.maximum(_log_softmax(z), -9.0)


def viterbi(doc: np.ndarray, e: np.ndarray, m: Model) -> np.ndarray:
    """The best states of all documents at once: step t takes the t-th line of every document that has one."""
    n = len(doc)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[head, n])
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    best = np.zeros((len(head), 4))
    back = np.zeros((n, 4), np.int8)
    best[:] = m.begin + e[head]
    for t in range(1, size[0]):
        k = live[t]
        go = best[:k, :, None] + m.step[None]
        back[head[:k] + t] = go.argmax(1)
        best[:k] = go.max(1) + e[head[:k] + t]
    state = np.zeros(len(head), np.int64)
    for t in range(size[0] - 1, -1, -1):
        k = live[t]
        done = size[:k] == t + 1
        state[:k][done] = best[:k][done].argmax(1)
        at = head[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return out


def expected(doc: np.ndarray, e: np.ndarray, weight: np.ndarray, m: Model) -> np.ndarray:
    """How often each state is expected to follow each, by the forward-backward recursion over all documents at once. e: log-likelihood of the lines in each state; weight: how much a line's document counts."""
    n = len(doc)
    moves = np.zeros((4, 4))
    if not n:
        return moves
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[head, n])
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    like, step = np.exp(e - e.max(1, keepdims=True)), np.exp(m.step)
    ahead, scale = np.zeros((n, 4)), np.ones(n)
    for t in range(size[0]):
        at = head[: live[t]] + t
        x = (np.exp(m.begin) if t == 0 else ahead[at - 1] @ step) * like[at]
        scale[at] = x.sum(1)
        ahead[at] = x / scale[at][:, None]
    after = np.ones((len(head), 4))
    for t in range(size[0] - 1, -1, -1):
        at = head[: live[t]] + t
        if t:
            come = like[at] * after[: live[t]] / scale[at][:, None]
            moves += step * ((ahead[at - 1] * weight[at][:, None]).T @ come)
            after[: live[t]] = come @ step.T
    return moves


def fit_weights(f: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
    """Softmax regression by full-batch Adagrad; states weigh alike."""
    w = np.zeros((WIDTH, 4))
    if not len(f):
        return w.astype(np.float32)
    share = np.bincount(y, minlength=4)
    cost = (1 / np.maximum(1, share) / max(1, (share > 0).sum()))[y][:, None]
    hot = np.eye(4)[y]
    g2 = np.full_like(w, 1e-9)
    flat_idx = f.ravel()
    for _ in range(steps):
        z = np.zeros((len(f), 4))
        for j in range(f.shape[1]):
            z += w[f[:, j]]
        d = (np.exp(_log_softmax(z)) - hot) * cost
        g = np.column_stack([np.bincount(flat_idx, np.repeat(d[:, k], f.shape[1]), WIDTH) for k in range(4)]) + 2e-5 * w
        g2 += g * g
        w -= 0.15 * g / np.sqrt(g2)
    return w.astype(np.float32)


def seeds() -> list[tuple[str, int]]:
    """Short texts with one label for all their lines."""
    r = np.random.default_rng(1)
    words = ["The council approved the new budget on Monday after a long debate.", "Officials blamed rising costs for the delay, which could last until autumn, a spokesperson said.", "“This is no excuse,” the mayor told reporters on Tuesday.", "About 1,200 people gathered in the old town to protest against the plan.", "Analysts expect €12.4 million for the project, against €8.0 million a year ago."]
    prose = [
        " ".join(words), "\n\n".join(words), "\n".join(words), " ".join(words).upper(), " ".join(words).lower(), "\n".join(w.rstrip(".") for w in words[:2]),
        "The council approved the new budget on Monday after a long\ndebate. Officials blamed rising costs for the delay, which\ncould last until autumn, a spokesperson said. About 1,200\npeople gathered in the old town to protest.",
        "Der Stadtrat stimmte am Montag nach langer Debatte dem Haushalt zu. „Das können wir uns nicht leisten“, sagte die Bürgermeisterin.",
        "Le conseil a approuvé lundi le budget après un long débat. « Rien n’est décidé », a précisé le maire.",
        "El ayuntamiento aprobó el lunes el presupuesto. “No habrá más retrasos”, afirmó el alcalde.",
        "A câmara aprovou na segunda-feira o orçamento, segundo o autarca. A população não foi ouvida.",
        "Rada miasta zatwierdziła w poniedziałek budżet po długiej debacie. Mieszkańcy protestowali przed ratuszem.",
        "Совет одобрил бюджет в понедельник после долгих споров. Жители протестовали у ратуши.", "Το συμβούλιο ενέκρινε τον προϋπολογισμό τη Δευτέρα. Οι κάτοικοι διαμαρτυρήθηκαν.",
    ]
    heads = ["Council approves new budget", "Mayor rejects calls for a second vote", "Why the old bridge needs repair", "120 families join school protest", "“No more delays”: mayor speaks out", "Oldtown: €12.4 million for the harbour", "Minister shelved tax plan over rising costs"]
    lists = ["\n".join(f"{b}{h}" for h in heads) for b in ("", "- ", "* ", "• ", "– ")]
    lists += ["\n".join(f"{i}. {h}" for i, h in enumerate(heads, 1)), "\n".join(f"{i}) {h}" for i, h in enumerate(heads, 1))]
    lists += ["Smith, Jane (81), Oldtown\nMiller, John (74), Newport\nBrown, Ann (66), Oldtown", "14:30 Oldtown, council meeting\n18:00 Newport, open day\n9:15 Harbour, guided tour", "harbour, Oldtown, tax plan, Jane Smith, school, Newport, bridge repair, Miller, budget, open day, Brown, council, new vote"]
    tables = [s.join(("Team", "P", "W", "D", "L")) + "\n" + "\n".join(s.join([t, *map(str, r.integers(0, 40, 4))]) for t in ("Oldtown", "Newport United", "the city council", "Harbour")) for s in ("\t", " | ", ";", ", ", "   ")]
    tables += [s.join(("Item", "Open", "High", "Share")) + "\n" + "\n".join(s.join([t, f"{r.uniform(0, 400):.2f}", f"{r.uniform(0, 400):.2f}", f"{r.uniform(0, 60):.1f}%"]) for t in ("Smith Holdings", "Newport Group", "Bank")) for s in ("\t", " | ", ";", ", ", "   ")]
    tables += ["---|---|---|---|"]
    b64 = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    pick = lambda s, n: "".join(r.choice(np.array(list(s)), n))
    junk = ["\n".join("".join(r.choice(b64, 72)) for _ in range(6)) for _ in range(3)]
    junk += [" ".join(str(int(10 ** r.uniform(0, 6))) for _ in range(90)), " ".join(pick("qwrtypsdfghjkl", 2) + pick("aeioulkjhgfdsrt", int(r.integers(0, 9))) for _ in range(90)), " ".join(pick("*<>_|#^~%=+@", int(r.integers(1, 8))) for _ in range(40))]
    junk += ["   ".join(" ".join(w) for w in " ".join(words).split()), "\n".join(["Loading…"] * 8), "\n".join(["null"] * 8), "\n".join(["Click here"] * 9), "\n".join(["undefined"] * 7), "n/a", "…", ".", "—", "N/A", "-"]
    junk += ['<div class="menu">\n[block]\nvar slot = window.slot || [];\n{{ article.title }}\n%%name%%\n<span>', "the old town said the old town said the old town approved the old town said the mayor the old town said the old town said the mayor"]
    return [(t, PROSE) for t in prose] + [(t, LIST) for t in lists] + [(t, TABLE) for t in tables] + [(t, JUNK) for t in junk]


def learn(labelled: Sequence[tuple[str, str]], spec: Spec) -> Model:
    """labelled: (text, kind). Unknown kinds are left out."""
    docs = [(t or "", KINDS.index(k), False) for t, k in labelled if k in KINDS and (t or "").strip()]
    # prose comes wrapped too: every third text once more, in lines of another width
    r = np.random.default_rng(spec.seed)
    for t, k, _ in docs[::3]:
        if k == PROSE:
            wide = int(r.integers(42, 84))
            docs.append(("\n\n".join("\n".join(textwrap.wrap(x, wide)) for x in t.split("\n") if x.strip()), PROSE, False))
    docs += [(t, k, True) for t, k in seeds()] * 2
    doc, s = line_stats([t for t, _, _ in docs])
    f = features(doc, s)
    kind = np.array([k for _, k, _ in docs])[doc]
    sure = np.array([x for _, _, x in docs])[doc]
    y = kind.copy()
    m = Model(np.zeros((WIDTH, 4), np.float32), np.full((4, 4), np.log(0.25)), np.full(4, np.log(0.25)))
    # a document of another kind mostly has some prose; one called prose is seldom something else
    prior = np.full((4, 4), -4.0)
    np.fill_diagonal(prior, 0.0)
    prior[1:, PROSE] = 0.0
    known = np.flatnonzero(sure)
    for i in range(spec.rounds + 1):
        if i == 0:
            # the first round learns from lines that nothing contradicts: whole prose documents and the lines made here
            use = np.flatnonzero(sure | (kind == PROSE) | (s["common"] / np.maximum(1, s["words"]) < 0.2))
            m.weights = fit_weights(f[use], y[use], spec.steps)
        else:
            m.weights = fit_weights(f, y, spec.steps)
        # each line by itself: along the path, a line of prose above a table would be drawn into it round by round
        y = (emission(m, f) + prior[kind]).argmax(1)
        y[known] = kind[known]
    # transitions by expectation and maximization over the labelled documents, each held to what its label allows
    allowed = emission(m, f) + prior[kind]
    allowed[known] = np.where(np.eye(4, dtype=bool)[kind[known]], 0.0, -30.0)
    # kinds count alike, as in the weights
    kinds = np.array([k for _, k, _ in docs])
    alike = (len(docs) / 4 / np.maximum(1, np.bincount(kinds, minlength=4)))[kind]
    for _ in range(spec.turns):
        moves = expected(doc, allowed, alike, m) + spec.pseudo
        m.step = np.log(moves / moves.sum(1, keepdims=True))
    return m


def labelled_sample(documents: DataFrame, labels: DataFrame, spec: Spec) -> list[tuple[str, str]]:
    """At most spec.per_kind documents of each kind, the same ones on every run."""
    out = None
    for k in KINDS:
        some = labels.filter(F.col("kind") == k).select("doc_id", "kind").orderBy(F.xxhash64("doc_id", F.lit(spec.seed)), "doc_id").limit(spec.per_kind)
        out = some if out is None else out.unionByName(some)
    got = documents.select("doc_id", "text").join(F.broadcast(out), "doc_id").select("doc_id", "kind", "text").distinct().orderBy("kind", "doc_id").collect()
    return [(r["text"] or "", r["kind"]) for r in got]


SCHEMA = "doc_id long, chars long, lines long, words long, mean_word_length double, symbol_share double, digit_share double, stop_line_share double, common_word_share double, prose_share double, list_share double, table_share double, junk_share double"


def figures(texts: Sequence[str], m: Model) -> dict[str, np.ndarray]:
    n = len(texts)
    doc, s = line_stats(texts)
    state = viterbi(doc, emission(m, features(doc, s)), m)
    add = lambda v: np.bincount(doc, v, n)
    chars, words, lines = add(s["chars"]), add(s["words"]), add(np.ones(len(doc)))
    div = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    out = {"chars": np.array([len(t) for t in texts], np.int64), "lines": lines.astype(np.int64), "words": words.astype(np.int64), "mean_word_length": div(add(s["wordchars"]), words)}
    out |= {"symbol_share": div(add(s["signs"]), chars), "digit_share": div(add(s["digits"]), chars), "stop_line_share": div(add((s["last"] == 3) | (s["last"] == 4)), lines), "common_word_share": div(add(s["common"]), words)}
    return out | {f"{k}_share": div(add(s["chars"] * (state == i)), chars) for i, k in enumerate(KINDS)}


def quality(documents: DataFrame, labels: DataFrame, spec: Spec = Spec(), once: bool = True) -> DataFrame:
    """One row per document with its figures. Repeated rows count once (of an id with several texts, the least figures), unless the
    caller sees to it; a null id is left out."""
    m = learn(labelled_sample(documents, labels, spec), spec)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for a, z, part in flat.text_pieces(b.column(1).fill_null(""), 1 << 20):
                got = figures(part.to_pylist(), m)
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), *[pa.array(got[c]) for c in names[1:]]], names)

    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL").mapInArrow(run, SCHEMA)
    # figures travel, not texts
    return out.groupBy("doc_id").agg(F.min(F.struct(*names[1:])).alias("f")).select("doc_id", "f.*") if once else out


def no_prose(figures_: DataFrame) -> DataFrame:
    """doc_id of documents of which more than half is no running prose, or that are blank or bare signs."""
    return figures_.filter("prose_share < 0.5 OR words = 0 AND digit_share = 0").select("doc_id").distinct()
