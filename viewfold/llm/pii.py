"""Personal data by a semi-Markov conditional random field.

Whole spans are scored: a candidate segment's features look at all of it (digits, groups, check
sum, frame, words before it), and a segment-level Viterbi search over bounded segments jointly
chooses boundaries and types. Base matches by pattern are always part of the result; the field
adds spans that the patterns miss (parts with odd separators, spelled-out at-signs and dots, phone
numbers without a plus). It learns them from examples written by rule, set among words of the
corpus, beside what the patterns find and refuse in the corpus itself.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Longest segment in tokens, most tokens without a trigger inside a region.
MAX_TOKENS, REACH = 24, 3
FIT_ROWS, FIT_CHARS, EPOCHS, RATE, DECAY = 1_000, 50_000, 12, 0.2, 1e-3
#: Examples written by rule: of each kind, and of numbers that are none.
WRITTEN = 120

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin at the first digit of a run, so the look-behinds change no result and keep long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@+]|[(\[](?:at|dot)[)\]]|\bdot\b", re.IGNORECASE)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_matches(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind, less those that fail the kind's check."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if 16 <= len(m[0]) <= 37:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out["phone"].append(m.span())
    return out


def segment_features(kind: str, text: str, s: int, e: int) -> list[str]:
    """Names of the features that hold for text[s:e] as a segment of ``kind``."""
    x = text[s:e]
    digits = [c for c in x if "0" <= c <= "9"]
    n = len(digits)
    groups = [len(g) for g in re.findall(r"[0-9]+", x)]
    letters = sum(c.isalpha() for c in x)
    before, after = text[max(0, s - 1) : s], text[e : e + 1]
    low = x.lower()
    at = x.count("@") + len(re.findall(r"\bat\b", low))
    dots = x.count(".") + len(re.findall(r"\bdot\b", low))
    joined = n > 0 and not letters
    f = [
        "bias",
        f"digits{min(n, 20)}",
        f"groups{min(len(groups), 8)}",
        f"letters{min(letters, 3)}",
        f"at{min(at, 2)}",
        f"dots{min(dots, 4)}",
        f"plus{x.startswith('+')}",
        f"luhn{n >= 12 and joined and luhn(''.join(digits))}",
        f"octets{len(groups) == 4 and all(g <= 3 for g in groups) and all(int(v) <= 255 for v in re.findall(r'[0-9]+', x)) and joined}",
        f"run{any(g >= 8 for g in groups)}",
        f"even{len(set(groups)) == 1}",
        f"odd{sum(not (c.isalnum() or c in ' .-()+@_%') for c in x) > 0}",
        f"space{x.count(' ') > 0}",
        f"left{'d' if before.isdigit() else 'w' if before.isalpha() else 'p' if before in tuple('.-+@_%') and before else 's'}",
        f"right{'d' if after.isdigit() else 'w' if after.isalpha() else 'p' if after in tuple('-+@_%') and after else 's'}",
        f"ends{x[0].isalnum() or x[0] in '+('}{x[-1].isalnum()}",
        f"mail{at == 1 and dots >= 1 and letters >= 3 and x[-1].isalpha()}",
        f"spelled{'@' not in x}{min(len(re.findall(r'[(\[](?:at|dot)[)\]]', low)), 2)}",
        f"bare{min(len(re.findall(r'(?<![(\[])\b(?:at|dot)\b(?![)\]])', low)), 3)}",
        f"host{len(x) - 1 - max(x.rfind('.'), low.rfind('dot') + 2) if letters else 0}",
        f"lead{x[0] if x[0] in '+(0' else '-'}",
        f"signs{''.join(sorted({c for c in x if not c.isalnum()}))[:6]}",
        f"words{min(len(low.split()), 6)}",
    ]
    return [f"{kind}:{name}" for name in f]


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens around triggers. Outside them no candidate exists, so the best labelling of
    the whole text is the best labelling of each region."""
    out: list[list[tuple[int, int]]] = []
    seen = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < seen:
            continue
        lo = m.start()
        steps = 0
        back = REACH + 1 if m[0].isalpha() else REACH - 1  # a bare word stands behind a whole address
        while lo > seen and steps < 40 * REACH and text[lo - 1] != "\n":
            lo -= 1
            steps += 1
            if text[lo].isspace() and text[lo + 1 : m.start()].count(" ") >= back:
                break
        tokens: list[tuple[int, int]] = []
        quiet = 0
        for t in _TOKEN.finditer(text, lo):
            if tokens and "\n" in text[tokens[-1][1] : t.start()] and t.start() > m.end():
                break
            tokens.append(t.span())
            if t.start() > m.end():
                quiet = 0 if _TRIGGER.match(text, t.start()) or t[0].lower() in ("at", "dot") or not t[0].isalnum() else quiet + 1
            if quiet > REACH:
                break
        if tokens:
            seen = tokens[-1][1]
            out.append(tokens)
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(first token, end token, kind) of segments worth scoring: at most MAX_TOKENS tokens, begun
    and ended where a segment of the kind can be."""
    out = []
    words = [text[s:e] for s, e in tokens]
    words = [w.lower() if len(w) < 4 else w for w in words]
    for i, w in enumerate(words):
        digit = w.isdigit()
        if not (w.isalnum() or w in "+("):
            continue
        n = at = dots = letters = 0
        for j in range(i, min(len(words), i + MAX_TOKENS)):
            v = words[j]
            if j > i and tokens[j][0] - tokens[j - 1][1] > 2:
                break
            if v.isdigit():
                n += len(v)
            elif v == "@" or v == "at":
                at += 1
            elif v == "." or v == "dot":
                dots += 1
            elif v.isalnum():
                letters += 1
            numeric = letters == 0 and at == 0
            if numeric and v.isdigit():
                if digit and dots == 3 and n <= 12:
                    out.append((i, j + 1, "ip"))
                if digit and 12 <= n <= 19:
                    out.append((i, j + 1, "card"))
                if (digit or w in "+(") and 8 <= n <= 15 and (j > i or n <= 12):
                    out.append((i, j + 1, "phone"))
            if at == 1 and dots >= 1 and v.isalpha() and v not in ("at", "dot") and j - i >= 4:
                out.append((i, j + 1, "email"))
            if at > 1 or (not numeric and letters > 8) or n > 24:
                break
    return out


@dataclass
class SemiCRF:
    weights: dict[str, float]

    def score(self, kind: str, text: str, s: int, e: int) -> float:
        return sum(self.weights.get(f, 0.0) for f in segment_features(kind, text, s, e))

    def decode(self, text: str, tokens: list[tuple[int, int]], base: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """Best segmentation of a region; tokens outside segments score 0. Segments that touch a
        base match are left to it."""
        taken, k = [0], 0  # how many tokens up to each one touch a base match
        for s, e in tokens:
            while k < len(base) and base[k][1] <= s:
                k += 1
            taken.append(taken[-1] + (k < len(base) and base[k][0] < e))
        ending: dict[int, list[tuple[int, str, float]]] = {}
        for i, j, kind in candidates(text, tokens):
            if taken[i] == taken[j] and (v := self.score(kind, text, tokens[i][0], tokens[j - 1][1])) > 0:
                ending.setdefault(j, []).append((i, kind, v))
        best, back = [0.0], [None]
        for j in range(1, len(tokens) + 1):
            b, k = best[j - 1], None
            for i, kind, v in ending.get(j, ()):
                if best[i] + v > b + 1e-12:
                    b, k = best[i] + v, (i, kind)
            best.append(b)
            back.append(k)
        out, j = [], len(tokens)
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
        return out[::-1]


def written(kind: str, rnd: random.Random) -> str:
    """An example of a kind in a form that its base pattern misses, or, for "none", a number that
    is no personal data."""
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    name = lambda lo, hi: "".join(rnd.choice("abcdefghijklmnoprstuvwxyz") for _ in range(rnd.randint(lo, hi)))
    if kind == "email":
        at = rnd.choice(["@", " @ ", "(at)", " (at) ", "[at]", " [AT] ", " (AT) ", " at ", " AT "])
        plain = [".", " . "] if at not in ("@", " at ", " AT ") else []
        dot = rnd.choice([*plain, "(dot)", " (dot) ", " [dot] ", " (DOT) ", " dot ", " DOT "])
        user = name(3, 8) + rnd.choice(["", "", "." + name(3, 7), digits(2)])
        parts = [name(3, 9), *([name(3, 8)] if rnd.random() < 0.3 else []), rnd.choice(["com", "org", "net", "de", "fr", "es", "io"])]
        return user + at + dot.join(parts)
    if kind == "ip":
        sep = rnd.choice([" . ", "[.]", "(.)", " dot ", " (dot) ", " [dot] "])
        return sep.join(str(rnd.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rnd.choice([".", "/", "  ", " - ", "_", ". "]).join(d[k : k + 4] for k in range(0, 16, 4))
    if kind == "phone":
        a, sep = str(rnd.randint(2, 9)), rnd.choice(["-", " ", "."])
        return rnd.choice(
            [f"0{a}{digits(2)}/{digits(rnd.randint(6, 8))}", f"({'0' + a + digits(1)}) {digits(3)}{sep}{digits(4)}", f"00{a}{digits(1)}{sep}{digits(2)}{sep}{digits(7)}", f"0{a}{digits(1)}{sep}{digits(3)}{sep}{digits(2)}{sep}{digits(2)}", f"0{a}{digits(1)} {digits(7)}"]
        )
    bad = digits(15)
    bad += rnd.choice([c for c in "0123456789" if not luhn(bad + c)])
    year = rnd.randint(1900, 2030)
    return rnd.choice(
        [bad, " ".join(bad[k : k + 4] for k in range(0, 16, 4)), f"{year}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)} {rnd.randint(10, 23)}:{rnd.randint(10, 59)}:{rnd.randint(10, 59)}", f"{rnd.randint(10, 28)}/{rnd.randint(10, 12)}/{year}", f"{digits(1)}.{digits(rnd.randint(3, 12))}", f"{rnd.randint(1, 9)}{digits(2)},{digits(3)},{digits(3)}", f"{rnd.randint(1, 9)}{digits(rnd.randint(6, 13))}", f"v{digits(1)}.{digits(1)}.{digits(2)}.{rnd.randint(300, 9999)}", f"{rnd.randint(256, 999)} . {digits(3)} . {digits(3)} . {digits(3)}", f"look at {name(4, 8)} dot {name(8, 12)} and", f"{name(4, 7)} at {name(4, 8)}. {name(4, 8)}", f"{digits(4)}-{digits(4)}", f"{rnd.randint(1, 9)}{digits(2)} {rnd.randint(1, 9)}{digits(2)} {rnd.randint(1, 9)}{digits(2)}"]
    )


def examples(texts: list[str], n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, true segments) for ``n`` written examples of each kind and twice as many of none, with
    words of the texts around them."""
    rnd = random.Random(seed)
    words = sorted({w for t in texts for w in re.findall(r"[^\W\d_]+", t[:2000])})[:20_000] or ["the", "of", "and", "see", "call", "or"]
    out = []
    for kind in (*KINDS, "none", "none"):
        for _ in range(n):
            before = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))
            after = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))
            span = written(kind, rnd)
            head = before + " " if before else ""
            tail = rnd.choice([" ", ". ", ", ", "\n"]) + after if after else rnd.choice(["", "."])
            out.append((head + span + tail, [(kind, len(head), len(head) + len(span))] if kind != "none" else []))
    return out


def sums(n: int, cands: list[tuple[int, int, str]], v: list[float]) -> tuple[float, list[float]]:
    """Log of the summed weight of all segmentations of ``n`` tokens, and each candidate's share."""
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (i, j, _) in enumerate(cands):
        ending[j].append(c)
        starting[i].append(c)
    a, b = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        a[j] = _logsum([a[j - 1], *(a[cands[c][0]] + v[c] for c in ending[j])]) if ending[j] else a[j - 1]
    for i in range(n - 1, -1, -1):
        b[i] = _logsum([b[i + 1], *(b[cands[c][1]] + v[c] for c in starting[i])]) if starting[i] else b[i + 1]
    return a[n], [math.exp(min(0.0, a[i] + v[c] + b[j] - a[n])) for c, (i, j, _) in enumerate(cands)]


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(y - top) for y in x))


def fit_crf(texts: list[str], n_written: int = WRITTEN) -> SemiCRF:
    """Maximum conditional likelihood by stochastic gradient. In the texts base matches are the true
    segments of their regions, in written examples the example is; every other candidate competes
    with them. Forward and backward sums run over all segmentations of a region."""
    data = []
    known = [(t, [(k, s, e) for k, spans in base_matches(t).items() for s, e in spans]) for t in texts]
    for text, true in known + examples(texts, n_written, 11):
        base = set(true)
        for tokens in regions(text):
            cands = candidates(text, tokens)
            if cands:
                feats = [segment_features(k, text, tokens[i][0], tokens[j - 1][1]) for i, j, k in cands]
                gold = [(k, tokens[i][0], tokens[j - 1][1]) in base for i, j, k in cands]
                data.append((len(tokens), cands, feats, gold))
    rng = np.random.default_rng(5)
    weights: dict[str, float] = {}
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 4)
        for at in rng.permutation(len(data)).tolist():
            n, cands, feats, gold = data[at]
            share = sums(n, cands, [sum(weights.get(f, 0.0) for f in fs) for fs in feats])[1]
            for fs, true, p in zip(feats, gold, share):
                step = rate * (true - p)
                if abs(step) > 1e-4:
                    for f in fs:
                        weights[f] = weights.get(f, 0.0) * (1 - rate * DECAY) + step
    return SemiCRF(weights)


def find_all(text: str | None, crf: SemiCRF) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, all spans) by kind, each in order of start."""
    text = text or ""
    if not _TRIGGER.search(text):
        empty: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        return empty, empty
    base = base_matches(text)
    flat: list[tuple[int, int]] = []  # base matches in order, those that overlap as one
    for s, e in sorted(x for spans in base.values() for x in spans):
        if flat and s < flat[-1][1]:
            flat[-1] = (flat[-1][0], max(e, flat[-1][1]))
        else:
            flat.append((s, e))
    full = {k: list(v) for k, v in base.items()}
    ends = [e for _, e in flat]
    for tokens in regions(text):
        lo = bisect_right(ends, tokens[0][0])
        hi = bisect_left(flat, (tokens[-1][1],))
        for kind, s, e in crf.decode(text, tokens, flat[lo:hi]):
            full[kind].append((s, e))
    return base, {k: sorted(v) for k, v in full.items()}


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> SemiCRF:
    """Fit on at most ``fit_rows`` texts of up to FIT_CHARS characters that hold digits or an
    at-sign, the first by hash of the text."""
    some = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).where((F.length("t") <= FIT_CHARS) & F.col("t").rlike("[0-9@]"))
    # hashes alone first, so that no task sends fit_rows texts
    hashes = [r.h for r in some.select("h").orderBy("h").limit(fit_rows).collect()]
    rows = some.where(F.col("h") <= hashes[-1]).select("h", "t").distinct().limit(fit_rows).collect() if hashes else []
    return fit_crf([r.t for r in sorted(rows)])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crf: SemiCRF | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base, spans)`` for each row of ``docs``: counts
    and places of the base matches, and all spans with what the field adds, as kind:start:end
    with code points and end exclusive, by kind, then start.

    Null texts are empty and empty texts have no spans. Null ids and repeated rows are handled
    like any other row. Other columns are not looked at; an empty table gives no rows. Texts stay
    where they are: no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(crf or train(docs, id_col, text_col, fit_rows))

    def run(batches):
        for b in batches:
            found = [find_all(t, model.value) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array([len(x[k]) for x, _ in found], pa.int64()) for k in KINDS), pa.array([joined(x) for x, _ in found], pa.string()), pa.array([joined(y) for _, y in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
