"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds the segments the patterns miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"\+?[0-9][+0-9 ().\-]*")
#: Runs of numbers with dots between them: it matches at every digit, so it never looks back.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _addresses(dotted: str, start: int) -> Iterator[tuple[int, int]]:
    """Where four numbers of a run in turn are an address, parts at most 255; the four that fail are passed over as a match."""
    parts = dotted.split(".")
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        size = sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            yield start, start + size
        start += size + 1


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind, that pass their kind's test; by kind, then start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    free, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and (c := text[left - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            left -= 1
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            free = domain.end()
            found["email"].append(("email", left, free))
        at = text.find("@", max(at + 1, free))
    for run in _RUN.finditer(text):
        lo, hi = run.span()
        n = hi - lo
        if n < 7:
            continue
        if run[0].count(".") >= 3:
            for m in _DOTTED.finditer(text, lo, hi):
                found["ip"] += [("ip", a, b) for a, b in _addresses(m[0], m.start())]
        if n >= 16:
            for m in _CARD.finditer(text, lo, hi):
                digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 64 else ""
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(("card", *m.span()))
        if "+" in run[0]:
            for m in _PHONE.finditer(text, lo, hi):
                if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found["phone"].append(("phone", *m.span()))
    return [s for k in KINDS for s in found[k]]


def joined(spans: list[Span]) -> str:
    """kind:start:end, by kind as listed and then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# ---- the random field: regions that may hold personal data, their tokens, whole-span features

_AT = re.compile(r"@|[\[(] ?at ?[\])]")
_AFTER_AT = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]+)*")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().+\-]*[0-9]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|[^\sA-Za-z0-9]")
#: Words that announce a kind, looked for in the 24 characters before a region.
_CUES = ("tel", "phone", "call", "mail", "ip", "host", "card", "visa")
#: An entity has at most so many tokens and characters, a number at most so many runs of digits; the fit reads regions of MOST_FIT characters at most.
MAX_TOKENS, MAX_CHARS, MAX_RUNS, MOST_FIT = 40, 320, 8, 400


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches with an at sign (or its spelling) or at least seven digits or three dots between digits, leftmost first, none overlapping.

    At signs are looked for first and grown to both sides, numbers are runs: every character is read a bounded number of times, however long its run.
    """
    out: list[tuple[int, int]] = []
    at, free, ats = 0, 0, _AT.finditer(text)
    mail: tuple[int, int, int] | None = None  # where the local part begins and ends, and the region's end

    def next_mail() -> tuple[int, int, int] | None:
        for m in ats:
            after = _AFTER_AT.match(text, m.end())
            end = m.start() - (m.start() > free and text[m.start() - 1] == " ")
            left = end
            while left > free and text[left - 1] in _LOCAL:
                left -= 1
            if after and left < end:
                return left, end, after.end()
        return None

    mail, number = next_mail(), _NUMBER.search(text)
    while mail or number:
        if mail and mail[1] <= at:
            mail = next_mail()
        elif number and number.start() < at:
            number = _NUMBER.search(text, at)
        elif mail and (not number or max(mail[0], at) <= number.start()):
            out.append((max(mail[0], at), mail[2]))
            at = free = mail[2]
            mail = next_mail()
        else:
            digits = sum(map(str.isdigit, number[0]))
            if digits >= 7 or number[0].count(".") >= 3:
                out.append(number.span())
            at = free = number.end()
            number = _NUMBER.search(text, at)
    return out


def by_region(found: list[tuple[int, int]], spans: list[Span]) -> Iterator[tuple[int, int, list[Span]]]:
    """Each region with the spans that touch it, in one walk over both."""
    rest, active = iter(sorted(spans, key=lambda s: s[1])), []
    ahead = next(rest, None)
    for lo, hi in found:
        while ahead and ahead[1] < hi:
            active.append(ahead)
            ahead = next(rest, None)
        active = [s for s in active if s[2] > lo]
        yield lo, hi, [s for s in active if s[1] < hi]


def tokens(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, lo, hi)]


def span_features(text: str, lo: int, hi: int) -> list[str]:
    """Features of one whole segment; the same for every kind, weights are per kind."""
    s = text[lo:hi]
    digits = _NOT_DIGIT.sub("", s)
    n = len(digits)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: str(min(9, len(m[0]))), s[:64]))
    parts = s.split(".")
    before, after = text[lo - 1 : lo], text[hi : hi + 1]
    out = ["bias", f"n{min(n, 20)}", f"first{'9' if s[0].isdigit() else 'a' if s[0].isalpha() else s[0]}", f"shape{shape}" if len(shape) <= 24 else "shape-long"]
    out += [f"has{c}" for c in "@+().-[ " if c in s]
    if n >= 13 and n == len(s.replace(" ", "").replace("-", "")):
        out.append("luhn" if luhn(digits) else "no-luhn")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        out.append("octets")
    if re.search(r"@|[\[(] ?at ?[\])]", s):
        out += ["at", "dotted" if re.search(r"(\.|[\[(] ?dot ?[\])]) ?[A-Za-z]{2,}\Z", s) else "undotted"]
    if re.fullmatch(r"(\+[0-9]{1,3} ?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s):
        out.append("grouped")
    for side, c in (("before", before), ("after", after)):
        out.append(f"{side}{'9' if c.isdigit() else 'a' if c.isalpha() else '_' if c.isspace() or not c else '.'}")
    cue = text[max(0, lo - 24) : lo].lower()
    return out + [f"cue-{c}" for c in _CUES if c in cue]


def possible(s: str) -> tuple[bool, ...]:
    """Which kinds a segment can be at all: an address needs an at sign and a dot, an ip four octets, a card 13 to 19 digits, a phone 7 to 15 without letters."""
    n, plain = sum(c.isdigit() for c in s), not any(c.isalpha() for c in s)
    at = re.search(r"@|[\[(] ?at ?[\])]", s)
    parts = s.split(".")
    return (
        bool(at and re.search(r"(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z]{2,}\Z", s[at.end() :])),
        len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
        plain and 13 <= n <= 19,
        plain and 7 <= n <= 15,
    )


@dataclass
class SemiCrf:
    """Weights per kind and feature. A segmentation scores the sum over its segments; tokens outside any entity score 0."""

    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {k: {} for k in KINDS})

    def candidates(self, text: str, cut: list[tuple[int, int]], taken: list[Span] = []) -> Iterator[tuple[int, int, list[str], tuple[bool, ...]]]:
        """Candidate segments (first token, token after the last, features, kinds) in order of their first token, none that touches a taken span.

        cut has the region's tokens. None is longer than MAX_TOKENS tokens or MAX_CHARS characters, none without an at sign has more than MAX_RUNS runs of digits.
        """
        digits, runs, letters, held, k, reach, mail = [0], [0], [0], [0], 0, 0, False
        taken = sorted(taken, key=lambda t: t[1])
        for a, b in cut:
            while k < len(taken) and taken[k][1] < b:
                reach, k = max(reach, taken[k][2]), k + 1
            held.append(held[-1] + (reach > a))
            digits.append(digits[-1] + (b - a if text[a].isdigit() else 0))
            runs.append(runs[-1] + text[a].isdigit())
            letters.append(letters[-1] + text[a].isalpha())
        if cut:
            mail = bool(_AT.search(text, cut[0][0], cut[-1][1]))
        for i, (a, _) in enumerate(cut):
            if text[a].isspace() or text[a] in ").-]%":
                continue
            for j in range(i, min(len(cut), i + MAX_TOKENS)):
                b, n = cut[j][1], digits[j + 1] - digits[i]
                if held[j + 1] > held[i] or b - a > MAX_CHARS or not mail and (n > 19 or runs[j + 1] - runs[i] > MAX_RUNS):
                    break  # it only grows from here
                if b - a < 5 or not (text[b - 1].isascii() and text[b - 1].isalnum()):
                    continue
                if not mail and (letters[j + 1] > letters[i] or n < 7) and j - i != 6:
                    continue  # neither a card nor a phone number nor four octets
                kinds = possible(text[a:b])
                if any(kinds):
                    yield i, j + 1, span_features(text, a, b), kinds

    def lattice(self, text: str, lo: int, hi: int) -> tuple[int, list[tuple[int, int, list[str], tuple[bool, ...]]]]:
        """The number of tokens of a region and all its candidate segments, in a list: for the fit and for tests; decoding takes them one by one."""
        cut = tokens(text, lo, hi)
        return len(cut), list(self.candidates(text, cut))

    def scores(self, found: list[tuple[int, int, list[str], tuple[bool, ...]]]) -> np.ndarray:
        """Segments x kinds; a kind that a segment can't be scores -1000."""
        w = [self.weights[k] for k in KINDS]
        return np.array([[sum(w[k].get(f, 0.0) for f in fs) if ok[k] else -1e3 for k in range(len(KINDS))] for _, _, fs, ok in found]).reshape(len(found), len(KINDS))

    def decode(self, text: str, lo: int, hi: int, taken: list[Span]) -> list[Span]:
        """The best segmentation of a region by semi-Markov dynamic programming; segments that touch a taken span are left out.

        Segments come by their first token and are scored one by one, so memory is a few numbers a token.
        """
        cut = tokens(text, lo, hi)
        n, done, weights = len(cut), 0, [self.weights[k] for k in KINDS]
        best: list[float] = [0.0] * (n + 1)
        back: list[tuple[int, int] | None] = [None] * (n + 1)  # of the best segment that ends here: first token and kind
        ending: list[float] = [0.0] * (n + 1)

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                best[done] = best[done - 1]
                if back[done] and ending[done] > best[done] + 1e-12:
                    best[done] = ending[done]
                else:
                    back[done] = None

        for i, j, fs, ok in self.candidates(text, cut, taken):
            settle(i)  # no later segment ends at or before its own first token
            own = [sum(w.get(f, 0.0) for f in fs) if k else -1e3 for w, k in zip(weights, ok, strict=True)]
            top = max(own)
            if back[j] is None or best[i] + top > ending[j] + 1e-12:
                ending[j], back[j] = best[i] + top, (i, own.index(top))
        settle(n)
        out, j = [], n
        while j > 0:
            if back[j]:
                i, kind = back[j]
                out.append((KINDS[kind], cut[i][0], cut[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def fit(self, examples: list[tuple[str, int, int, list[Span]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> SemiCrf:
        """Maximise the conditional likelihood of the marked segmentations by stochastic gradient; expectations come from the forward-backward recursion."""
        built = []
        for text, lo, hi, gold in examples:
            cut = tokens(text, lo, hi)
            n, found = len(cut), list(self.candidates(text, cut))
            mark = {(a, b): KINDS.index(k) for k, a, b in gold}
            if found:
                built.append((n, found, [mark.get((cut[i][0], cut[j - 1][1]), -1) for i, j, *_ in found]))
        rng = np.random.default_rng(seed)
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for x in rng.permutation(len(built)):
                n, found, gold = built[x]
                s = self.scores(found)
                whole = np.logaddexp.reduce(s, axis=1)
                ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                ahead[0] = behind[n] = 0.0
                by_end: dict[int, list[int]] = {}
                by_start: dict[int, list[int]] = {}
                for e, (i, j, *_) in enumerate(found):
                    by_end.setdefault(j, []).append(e)
                    by_start.setdefault(i, []).append(e)
                for j in range(1, n + 1):
                    ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[found[e][0]] + whole[e] for e in by_end.get(j, ()))])
                for i in range(n - 1, -1, -1):
                    behind[i] = np.logaddexp.reduce([behind[i + 1], *(whole[e] + behind[found[e][1]] for e in by_start.get(i, ()))])
                for e, (i, j, fs, _) in enumerate(found):
                    p = np.exp(ahead[i] + s[e] + behind[j] - ahead[n])
                    for k, kind in enumerate(KINDS):
                        g = (gold[e] == k) - p[k]
                        if abs(g) > 1e-4:
                            w = self.weights[kind]
                            for f in fs:
                                w[f] = w.get(f, 0.0) * (1 - decay) + step * g
        return self


def _variants(text: str, lo: int, hi: int, gold: list[Span]) -> list[tuple[str, int, int, list[Span]]]:
    """Spellings that the patterns miss, made from a marked one: a phone number without its country code, an address with its at sign spelled out."""
    if len(gold) != 1 or gold[0][1] != lo or gold[0][2] != hi:
        return []
    kind, s = gold[0][0], text[lo:hi]
    new = re.sub(r"\A\+[0-9]{1,3} ?", "", s) if kind == "phone" else s.replace("@", " [at] ") if kind == "email" else s
    if new == s or kind == "phone" and "(" not in new and "-" not in new:
        return []
    return [(text[:lo] + new + text[hi:], lo, lo + len(new), [(kind, lo, lo + len(new))])]


def train(docs: DataFrame, max_docs: int = 3000, max_regions: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> SemiCrf:
    """Fit the field on regions of about max_docs documents (a documented bound; chosen by a hash of the id), at most max_regions of them, none longer than
    MOST_FIT characters.

    The patterns mark the segments; every seventh marked one also gives a variant spelling. Regions without a mark teach what is no personal data.
    """
    bound_batches(docs.sparkSession)
    n = docs.count()
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("pii")), F.lit(1 << 30)) / float(1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                for lo, hi, near in by_region(regions(t), base_spans(t)):
                    if hi - lo <= MOST_FIT:
                        inside = sorted((s for s in near if s[1] >= lo and s[2] <= hi), key=lambda s: (KINDS.index(s[0]), s[1]))
                        inside = [s for i, s in enumerate(inside) if not any(o[1] < s[2] and s[1] < o[2] for o in inside[:i])]
                        rows.append((t[max(0, lo - 24) : hi + 1], lo - max(0, lo - 24), hi - max(0, lo - 24), joined([(k, a - max(0, lo - 24), z - max(0, lo - 24)) for k, a, z in inside])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), (), ()), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["text", "lo", "hi", "gold"])

    sample = docs.filter(F.col(text_col).isNotNull() & (place < min(1.0, max_docs / max(1, n)))).select(F.col(text_col).alias("text"))
    got = sample.mapInArrow(cut, "text string, lo int, hi int, gold string").orderBy(F.xxhash64("text", "lo"), "text", "lo").limit(max_regions).collect()
    examples = [(r.text, r.lo, r.hi, [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.gold.split(",") if x)]) for r in got]
    return SemiCrf().fit(examples + [v for x in [e for e in examples if e[3]][::7] for v in _variants(*x)])


def find(text: str | None, model: SemiCrf | None) -> tuple[list[Span], list[Span]]:
    """(spans of the patterns, all spans) of a whole text; null has none. Added spans never overlap one of the patterns."""
    if not text:
        return [], []
    base = base_spans(text)
    added = [s for lo, hi, near in by_region(regions(text), base) for s in model.decode(text, lo, hi, near)] if model else []
    return base, base + added


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in square brackets; spans that overlap become one, named by the first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return text if text is None or not spans else "".join(out) + text[at:]


def detect(docs: DataFrame, model: SemiCrf | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Rows (id, *keep, n_email, n_ip, n_card, n_phone, base_sha256, spans[, redacted]), one for each row of docs, from whole texts.

    The counts and the digest are of the patterns' spans; spans has those and the added ones. Positions are code points, ends exclusive. A null text
    counts as empty: no spans, and redacted stays null. Rows that repeat, or repeat an id, keep a row each; an empty table gives an empty one; columns that
    keep doesn't name are left behind, whatever their names. Without a model only the patterns find. Added spans are bounded as entities are: MAX_TOKENS
    tokens, MAX_CHARS characters, MAX_RUNS runs of digits in a number. Time and memory grow with the text's length.
    """
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, texts = [[] for _ in KINDS], [], [], []
            for t in b.column(b.num_columns - 1):
                t = t.as_py()
                base, every = find(t, shipped.value)
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                texts.append(redact(t, every) if with_text else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in counts), *(pa.array(x, pa.string()) for x in (digests, spans, texts))], [*b.schema.names[:-1], *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])

    slim = docs.select(docs[id_col].alias("k0"), *(docs[c].alias(f"k{i + 1}") for i, c in enumerate(keep)), docs[text_col].alias("text"))
    schema = ", ".join(f"{c} {t}" for c, t in slim.dtypes[:-1])
    out = slim.mapInArrow(work, f"{schema}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, redacted string")
    return out.select(F.col("k0").alias(id_col), *(F.col(f"k{i + 1}").alias(c) for i, c in enumerate(keep)), *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(["redacted"] if with_text else []))
