"""Text that was decoded with the wrong character encoding (problem 4).

UTF-8 read as a legacy page: each character is mapped back to its byte in that page; an automaton over the bytes, written as a regular
expression, finds the maximal spans of well-formed multibyte sequences, and only these spans are decoded. What went wrong several times
is undone step by step. Sequences of which a byte was lost ("?" or a plain space in its place) are found by the same automaton with holes.

Bytes alone can't tell a misread span from proper characters that happen to be well-formed, so each reading is weighed by a character
model: the likelihood of the text around and in the span, as it stands and as decoded. The model holds counts of single characters, pairs
and triples over all texts of the table, beside a few sentences of common languages; well-formed spans and words of two alphabets are left
out of the counts. Characters never seen are weighed by their script, so no script is barred. The same model judges one legacy page read
as another, word by word, and question marks in the place of lost letters.

Correct foreign words and signs are left alone. A null or empty text is never affected. A field is whole if nothing in it is lost:
no sequence with a hole, no replacement character, no control character left.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm import flat

#: Pages UTF-8 may have been read as, most common first.
PAGES = ("cp1252", "iso8859-15", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "cp1254", "cp1257", "cp1253")
#: Pages that Western European text may have been read as.
SINGLE = ("cp1251", "cp437", "mac_roman", "cp850", "cp866", "koi8_r", "cp1253", "cp1250")

#: Well-formed UTF-8 of two to four bytes, in characters U+0080 to U+00FF that stand for bytes.
WELL_FORMED = (
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
_SPANS = re.compile(WELL_FORMED)
#: The same with bytes lost: "?" for any byte, a space for the no-break space.
_HOLES = re.compile("[\xc2-\xdf][? ]|[\xe0-\xef](?:\\?[\x80-\xbf]|[\x80-\xbf][? ]|\\?\\?)|[\xe0-\xef]\\?(?![\x80-\xbf?])")
_RUN = re.compile("[\x80-\U0010ffff]{2,}")
_MARKS = re.compile(r"(?<=[^\W\d_])\?{1,4}(?=[^\W\d_])|(?<=[^\W\d_])\?{2,4}(?= [^\W\d_])|(?<![\w?!.])\?{2,4}(?=[^\W\d_])|(?<![\S])\?{2,3}(?=\d| [^\W\d_])")
#: What a hole must start with or hold, in the same reading.
_HOLLOW = re.compile("[\xc2-\xef][? \x80-\uffff]?[? ]")
_LOST = re.compile("[�\x80-\x9f]")
#: Any of these must hold for a text to be looked at; also the test that runs in the JVM.
SUSPECT = r"[^\x00-\x7f]|[A-Za-z ]\?+[A-Za-z0-9]|\?\?"
_ANY = re.compile(SUSPECT)
_WORD = re.compile("[^ \n]*[\x80-\U0010ffff][^ \n]*")

#: A few sentences of common languages, so that the model isn't empty where the table is small.
SEED = """The council approved the new budget on Monday. “This is no excuse,” the mayor’s office said – it’s a €3.4 million plan, £12 a head… 20 °C, 50 % © 2026 § 12 ½ ± 2 × 3 · 4 →
Is it over?? Nobody knows. Why? Who pays?? No one. What?! Yes.
À l’école, le coût s’élève à 12 millions d’euros. « Rien n’est décidé », a précisé Zoë après la décision du gouvernement. Où ça ? L’œuvre a été achevée là-bas, même si rien n’était prêt. PRÈS DE L’ÉCHEC À ÇA. CAFÉ. Garçon, forêt, août, naïf, aiguë, île.
Für Schüler in Köln ist die Brückensanierung längst überfällig. „Das können wir uns nicht leisten“, sagte die Bürgermeisterin Größe Straße müssen Übung Änderung Öl. Wärmezuschuss, Flächennutzung.
¿Quién pagará? “No habrá más retrasos”, afirmó él el sábado. La licitación pública aplazó el subsidio lácteo en Málaga; el niño, según el señor Muñoz. ¡Qué pena! pingüino, sequía, criticó, aquí, país.
A população não foi ouvida: são 3,5 milhões — é a solução. NÃO É SÓ ISSO, DIZ A OPOSIÇÃO. Às vezes, a licitação pública põe em risco três famílias. pôde, avô, lições, mães.
La perché città più è così già può metà. Il caffè è là. Rada miasta zatwierdziła budżet po długiej debacie. Mieszkańcy są źli, że coś się dzieje: Łódź, święto, ćma, ośrodek.
Příliš žluťoučký kůň úpěl ďábelské ódy. Tűrő árvíz, őszi büdzsé. Şehirde yaşayan çocuğu gördü, ığdır, İzmir. În oraș și țară, câine, ăsta. Ångström, Øresund, smørrebrød, här, får, över, på, är, både. Žarisford, Šiauliai, čia, ēka, ļoti.
Ціна зросла, пише видання. Рік і ліс, місто Ґ, єдність, їжа. Совет одобрил бюджет в понедельник после долгих споров. Жители протестовали у ратуши; объём, ещё, эта. Η απόφαση αναβάλλεται. Το συμβούλιο ενέκρινε τον προϋπολογισμό τη Δευτέρα, ώρα, ήταν, έχει.
La col·lecció d’intel·ligència és paral·lela, l’Àngel ho diu així: excel·lent. Œuvre, Þórður býr á Íslandi og það er gott, ð, æ. 5 µm, 3 Ω, π ≈ 3,14, √2, ≤ 4, ≥ 5, ≠ 6, ∞, ∑, x ± y, × ÷."""


@dataclass(frozen=True)
class Spec:
    """sure: gain in log-likelihood from which a text counts as misread; word: the same for one legacy page read as another;
    mark: the same for question marks in the place of letters; rare: the same for a single character of two bytes
    that no text has; odd: the cost of a character beyond which a reading is no ordinary text either, less by two where only "?" speaks
    for it and by five for a single "?"."""

    sure: float = 4.0
    word: float = 4.3
    mark: float = 7.0
    rare: float = 15.0
    odd: float = 9.5


# --- the character model ------------------------------------------------------------------------------------------------------------

#: Multipliers of the hashes (fixed values); bits of the tables of triples, pairs and single characters.
M1, M2, M3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
BITS3, BITS2, ONES = 22, 20, 1 << 17
M64 = (1 << 64) - 1
EAST = {"CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "FULLWIDTH", "HALFWIDTH", "IDEOGRAPHIC"}


@lru_cache(1 << 16)
def script(c: str) -> str:
    """The script of a letter or mark; "" for all else."""
    if c.isalpha() or unicodedata.category(c)[0] == "M":
        name = unicodedata.name(c, "?").split()[0]
        return "CJK" if name in EAST else name
    return ""


@lru_cache(1 << 18)
def strangeness(before: str, c: str) -> float:
    """Cost of a character as far as its script tells, in nats."""
    if c < "\x80":
        return 4.0
    s, kind = script(c), unicodedata.category(c)
    if not s:
        return 20.0 if kind in ("Cc", "Cn", "Co", "Cs") or c == "�" else 9.0
    size, prior = (8.0 if s == "CJK" else 5.0), script(before)
    return size + (0.0 if prior == s or s == "COMBINING" and prior else 4.0 if not prior else 10.0)


@dataclass
class Model:
    ones: array
    twos: array
    threes: array
    total: float
    memo: dict[str, float] = field(default_factory=dict)
    words: dict[str, list] = field(default_factory=dict)

    def __getstate__(self):
        return self.ones, self.twos, self.threes, self.total

    def __setstate__(self, s):
        (self.ones, self.twos, self.threes, self.total), self.memo, self.words = s, {}, {}

    @property
    def letters(self) -> list[str]:
        """Letters and signs beyond ASCII that were seen more than once, often ones first."""
        if not hasattr(self, "_letters"):
            seen = np.frombuffer(self.ones, np.float32)[0x80 : ONES - 1]
            at = np.flatnonzero(seen > 1)
            self._letters = [chr(0x80 + i) for i in at[np.argsort(-seen[at], kind="stable")]]
        return self._letters

    def seen(self, s: str) -> bool:
        return all(self.ones[min(ord(c), ONES - 1)] > 0 for c in s)

    def oddest(self, s: str) -> float:
        """The largest cost of a triple with a character beyond ASCII."""
        return max((self.cost(s[i - 2 : i + 1]) for i in range(2, len(s)) if not s[i - 2 : i + 1].isascii()), default=0.0)

    def cost(self, s3: str) -> float:
        """-log P(s3[2] | s3[:2])."""
        got = self.memo.get(s3)
        if got is None:
            a, b, c = map(ord, s3)
            base = math.exp(-strangeness(s3[1], s3[2]))
            p1 = (self.ones[min(c, ONES - 1)] * (c < ONES - 1) + 50 * base) / (self.total + 50)
            n1, n2 = self.ones[min(b, ONES - 1)], self.twos[((a * M2 + b * M3) & M64) >> 64 - BITS2]
            pair = self.twos[((b * M2 + c * M3) & M64) >> 64 - BITS2]
            p2 = (pair + p1 + base) / (n1 + 2)
            # a triple can't be there more often than its pairs: hashes that collide are held down by this
            p3 = (min(self.threes[((a * M1 + b * M2 + c * M3) & M64) >> 64 - BITS3], pair, n2) + 4 * p2) / (n2 + 4)
            got = -math.log(max(min(p3, 1.0), 1e-30))
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            self.memo[s3] = got
        return got

    def readings(self, before: str, word: str, after: str, odd: float) -> list[tuple[str, str, float, bool]]:
        """(page, reading, gain, whether it is ordinary) of a word read as Western European, where that is likelier."""
        key = f"{before}{word}\0{after}"
        got = self.words.get(key)
        if got is None:
            now, got = self.text(before + word + after), []
            for page, x in _retold(word):
                g = now - self.text(before + x + after)
                if g > 0:
                    got.append((page, x, g, self.oddest(before + x + after) <= odd))
            if len(self.words) > 200_000:
                self.words.clear()
            self.words[key] = got
        return got

    def text(self, s: str) -> float:
        return sum(self.cost(s[i - 2 : i + 1]) for i in range(2, len(s)))


@lru_cache(1 << 16)
def _doubtful(run: str) -> tuple[tuple[int, int], ...]:
    """Spans of a run that the seed sentences alone would rather see decoded."""
    return tuple(sorted((s, e) for spans in _options(run).values() for s, e, got in spans if _gain(seed_model(), run, s, e, got) > 0))


def counts(texts: Sequence[str | None]) -> tuple[np.ndarray, ...]:
    """Counts of singles, pairs and triples as (table, place, count); what may be misread is left out."""
    keep = []
    for t in texts:
        if not t:
            continue
        if not t.isascii():
            cut = []
            for m in _RUN.finditer(t):
                cut += [(m.start() + s, m.start() + e) for s, e in _doubtful(m.group())]
            at = 0
            for s, e in sorted(cut):
                if s >= at:
                    keep.append(t[at:s])
                    at = e
            t = t[at:]
        keep.append(t)
    return _tally(keep)


def _tally(keep: Sequence[str]) -> tuple[np.ndarray, ...]:
    cp = np.frombuffer("\n\n".join(["", *keep, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # two alphabets side by side, and what stands for lost text
    alphabet = np.select([((cp | 32) >= 97) & ((cp | 32) <= 122) | (cp >= 0xC0) & (cp < 0x250) & (cp != 0xD7) & (cp != 0xF7), (cp >= 0x370) & (cp < 0x400), (cp >= 0x400) & (cp < 0x530)], [1, 2, 3], 0)
    ok = (cp != 0xFFFD) & ((cp < 0x80) | (cp > 0x9F))
    mixed = (alphabet[1:] != alphabet[:-1]) & (alphabet[1:] > 0) & (alphabet[:-1] > 0)
    ok[1:] &= ~mixed
    ok[:-1] &= ~mixed
    one = np.minimum(cp, np.uint64(ONES - 1))[ok]
    a, b, c = cp[:-2], cp[1:-1], cp[2:]
    two = ((b * np.uint64(M2) + c * np.uint64(M3)) >> np.uint64(64 - BITS2))[ok[1:-1] & ok[2:]]
    three = ((a * np.uint64(M1) + b * np.uint64(M2) + c * np.uint64(M3)) >> np.uint64(64 - BITS3))[ok[:-2] & ok[1:-1] & ok[2:]]
    out = [np.unique(x.astype(np.int64), return_counts=True) for x in (one, two, three)]
    return np.repeat([1, 2, 3], [len(k) for k, _ in out]), np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out])


def model_of(table: np.ndarray, place: np.ndarray, n: np.ndarray) -> Model:
    """From summed-up counts, with those of the seed sentences."""
    tables = [np.zeros(size, np.float32) for size in (ONES, 1 << BITS2, 1 << BITS3)]
    for t, k, x in ((table, place, n), _tally([*SEED.split("\n"), *SEED.title().split("\n")])):
        for i, held in enumerate(tables, 1):
            np.add.at(held, k[t == i], x[t == i].astype(np.float32))
    return Model(*(array("f", x.tobytes()) for x in tables), float(tables[0].sum()))


@lru_cache(1)
def seed_model() -> Model:
    none = np.zeros(0, np.int64)
    return model_of(none, none, none)


def fit(df: DataFrame, fields: Sequence[str]) -> Model:
    """The model of all texts of the fields. What reaches the driver are the tables, whose size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.columns:
                for _, _, part in flat.text_pieces(c.fill_null(""), 1 << 23):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in counts(part.to_pylist())], ["t", "k", "n"])

    each = df.select(*[F.col(f).cast("string").alias(f"c{i}") for i, f in enumerate(fields)])
    got = each.mapInArrow(run, "t long, k long, n long").groupBy("t", "k").agg(F.sum("n").alias("n")).toArrow()
    return model_of(*(got.column(c).to_numpy() for c in ("t", "k", "n")))


# --- readings -----------------------------------------------------------------------------------------------------------------------


@lru_cache(None)
def _to_bytes(page: str) -> dict[int, str]:
    """Character to byte (as U+0080..U+00FF) of a page; undefined bytes stand for themselves."""
    out = {b: chr(b) for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(page))] = chr(b)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@lru_cache(None)
def _table(page: str) -> dict[int, str]:
    """The same for str.translate; characters of the page's range that it doesn't have become none."""
    own = _to_bytes(page)
    return {**{b: "Ā" for b in range(0x80, 0x100)}, **own}


def _as_bytes(page: str, run: str) -> str:
    return run.translate(_table(page))


@lru_cache(1 << 16)
def _retold(word: str) -> tuple[tuple[str, str], ...]:
    """(page, the word read as Western European) for each page that has all its characters."""
    out = []
    for page in SINGLE:
        table = _to_bytes(page)
        try:
            got = "".join(c if c < "\x80" else table[ord(c)].encode("latin-1").decode("cp1252") for c in word)
        except (KeyError, UnicodeDecodeError):
            continue
        if got != word:
            out.append((page, got))
    return tuple(out)


Spans = tuple[tuple[int, int, str], ...]


@lru_cache(1 << 16)
def _options(run: str) -> dict[str, Spans]:
    """Per page the (start, end, original) of the well-formed spans of a run of non-ASCII characters."""
    out = {}
    for page in PAGES:
        spans = tuple((m.start(), m.end(), m.group().encode("latin-1").decode("utf-8")) for m in _SPANS.finditer(_as_bytes(page, run)))
        if spans:
            out[page] = spans
    return out


def _gain(m: Model, text: str, s: int, e: int, got: str) -> float:
    """By how much text[s:e] is likelier as `got`, in its place."""
    before, after = ("\n\n" + text[max(0, s - 2) : s])[-2:], text[e : e + 2]
    return m.text(before + text[s:e] + after) - m.text(before + got + after)


def _deep(m: Model, before: str, got: str, after: str) -> str:
    """A decoded span, itself decoded again where that is likelier: what went wrong twice is weighed as undone twice."""
    best = got
    for r in _RUN.finditer(got):
        for spans in dict.fromkeys(_options(r.group()).values()):
            again = got[: r.start()]
            at = 0
            for s, e, x in spans:
                again += r.group()[at:s] + x
                at = e
            again = _deep(m, before, again + r.group()[at:] + got[r.end() :], after)
            if m.text(before + again + after) < m.text(before + best + after):
                best = again
        break
    return best


def undo(text: str, m: Model, spec: Spec) -> tuple[str, bool]:
    """The text with its misread multibyte spans decoded, and whether it had any.

    The page that explains most of the text is sure once its gains are; then its smaller gains count too. Spans it doesn't explain
    need a sure page of their own.
    """
    runs, votes, known = [], {}, {}
    for r in _RUN.finditer(text):
        for page, spans in _options(r.group()).items():
            for s, e, got in spans:
                a, z = r.start() + s, r.start() + e
                if (a, z, got) not in known:
                    deep = _deep(m, ("\n\n" + text[max(0, a - 2) : a])[-2:], got, text[z : z + 2])
                    known[a, z, got] = deep, _gain(m, text, a, z, deep)
                got, g = known[a, z, got]
                if g > (spec.rare if e - s == 2 and not m.seen(got) else 0):
                    runs.append((page, r.start() + s, r.start() + e, got, g))
                    votes[page] = votes.get(page, 0.0) + g
    order = sorted((p for p in PAGES if votes.get(p, 0) >= spec.sure), key=lambda p: -votes[p])
    taken: list[tuple[int, int, str]] = []
    for page in order:
        mine = [(s, e, got, g) for p, s, e, got, g in runs if p == page and not any(s < y and x < e for x, y, _ in taken)]
        if sum(x[3] for x in mine) >= spec.sure:
            taken += [x[:3] for x in mine]
    if not taken:
        return text, False
    out, at = [], 0
    for s, e, got in sorted(taken):
        out += [text[at:s], got]
        at = e
    return "".join(out) + text[at:], True


def holes(text: str, m: Model, spec: Spec) -> Iterator[tuple[int, int]]:
    """Multibyte sequences of which a byte was lost, in Western European reading, and question marks for single lost letters."""
    for h in _HOLES.finditer(_as_bytes("cp1252", text)) if _HOLLOW.search(text) else ():
        mask = re.compile("".join("[\x80-\xbf]" if c == "?" else "\xa0" if c == " " else re.escape(c) for c in h.group()) + ("[\x80-\xbf]" if h.group()[0] >= "\xe0" and len(h.group()) < 3 else ""))
        fills = [c for c in m.letters if mask.fullmatch(c.encode().decode("latin-1"))]
        if fills and max(_gain(m, text, h.start(), h.end(), c) for c in fills) >= spec.sure:
            yield h.span()
    for q in _MARKS.finditer(text):
        n = len(q.group())
        letters = [c for c in m.letters[:160] if c.isalpha()]
        fills = set(letters if n == 1 else m.letters)
        if n in (2, 4):
            best = sorted(letters, key=lambda c: -_gain(m, text, q.start(), q.start() + 1, c))[:8]
            fills |= {x + y for x in (best if n == 2 else letters[:60]) for y in letters[:60]}
        gains = {c: _gain(m, text, q.start(), q.end(), c) for c in fills}
        best = max(gains, key=lambda c: (gains[c], c), default=None)
        around = lambda c: ("\n\n" + text[max(0, q.start() - 2) : q.start()])[-2:] + c + text[q.end() : q.end() + 2]
        if best and gains[best] >= spec.mark and m.oddest(around(best)) <= spec.odd - (5 if n == 1 else 2):
            yield q.span()


def other_page(text: str, m: Model, spec: Spec) -> str | None:
    """The text read as Western European again, where one page makes its words likelier by far."""
    told: dict[str, list[tuple[int, int, str]]] = {}
    total: dict[str, float] = {}
    for w in _WORD.finditer(text):
        s, e = w.span()
        before, after = ("\n\n" + text[max(0, s - 2) : s])[-2:], text[e : e + 2]
        for page, got, g, ordinary in m.readings(before, w.group(), after, spec.odd):
            told.setdefault(page, []).append((s, e, got, ordinary))
            total[page] = total.get(page, 0.0) + g * ordinary
    best = max((p for p in SINGLE if total.get(p, 0) > spec.word), key=lambda p: total[p], default=None)
    # a page that is sure beyond doubt explains the odd words too
    choice = [x[:3] for x in told[best] if x[3] or total[best] >= spec.rare] if best else None
    if choice is None:
        return None
    out, at = [], 0
    for s, e, got in choice:
        out += [text[at:s], got]
        at = e
    return "".join(out) + text[at:]


def examine(text: str | None, m: Model | None = None, spec: Spec = Spec()) -> tuple[bool, str | None, bool]:
    """(affected, restored, whole): whole is false where part of the original is lost."""
    if not text or not _ANY.search(text):
        return False, text, True
    m = m or seed_model()
    now, hit = undo(text, m, spec)
    more = hit
    for _ in range(4):
        if not more:
            break
        now, more = undo(now, m, spec)
    lost = any(True for _ in holes(now, m, spec)) or bool(_LOST.search(now))
    one = other_page(now, m, spec)
    if one is not None:
        now, hit = one, True
    return hit or lost, now, not lost


def _run(n: int, m: Model, spec: Spec):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, field_, text, restored, whole = [], [], [], [], []
            key = b.column(0).to_pylist()
            for i in range(n):
                name = b.schema.field(1 + i).name
                for k, t in zip(key, b.column(1 + i).to_pylist()):
                    bad, got, all_ = examine(t, m, spec)
                    if bad:
                        ids.append(k), field_.append(name), text.append(t), restored.append(got), whole.append(all_)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(field_, pa.string()), pa.array(text, pa.string()), pa.array(restored, pa.string()), pa.array(whole, pa.bool_())], ["id", "field", "found", "restored", "whole"])

    return go


def damaged(df: DataFrame, id_col: str, fields: Sequence[str], spec: Spec = Spec()) -> DataFrame:
    """id, field, found, restored, whole: each affected field once; of an id that comes with several texts, the least of them.

    Rows without a suspect sign never leave the JVM. A null id is left out.
    """
    m = fit(df, fields)
    src = df.select(F.col(id_col).cast("long").alias("__id"), *fields).filter(F.col("__id").isNotNull())
    some = None
    for f in fields:
        c = F.col(f).rlike(SUSPECT)
        some = c if some is None else some | c
    out = src.filter(some).mapInArrow(_run(len(fields), m, spec), "id long, field string, found string, restored string, whole boolean")
    return out.groupBy("id", "field").agg(F.min(F.struct("found", "restored", "whole")).alias("r")).select("id", "field", "r.*")
