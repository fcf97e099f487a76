"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"


def lower_ascii(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def by_id(value):
    return (value is None, value if value is not None else 0)


class Groups:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def suffix(texts: list[str | None], length: int = 400) -> list[tuple]:
    """(bytes, removed, spans, hash of the rest) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        starts = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), starts, sha(bytes(b for b, g in zip(d, gone, strict=True) if not g))))
    return out


def shingles(text: str | None, words: int) -> set:
    found = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    n = min(words, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()


def near(ids: list, texts: list[str | None], words: int, percent: int = 80) -> list[tuple]:
    """(shingles, smallest id reachable) per row."""
    sets = [shingles(t, words) for t in texts]
    groups = Groups(len(ids))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                groups.join(i, j)
    least = {}
    for i, x in enumerate(ids):
        r = groups.root(i)
        least[r] = min(least.get(r, x), x, key=by_id)
    return [(len(s), least[groups.root(i)]) for i, s in enumerate(sets)]


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))


def contaminated(texts: list, items: list[tuple], window: int = 10) -> list[tuple]:
    """(words, hit words, item ids) per text."""
    windows = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[i : i + window])].add(str(item))
    out = []
    for text in texts:
        w, hit, found = bench_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


def lines(ids: list, texts: list, min_chars: int = 40, min_docs: int = 5) -> list[tuple]:
    """(lines, dropped, text left) per row."""
    key = lambda line: lower_ascii(line.strip(SPACE))
    holders = defaultdict(set)
    for i, text in zip(ids, texts, strict=True):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in zip(ids, texts, strict=True):
        all_lines = (text or "").split("\n")
        kept = []
        for line in all_lines:
            found = holders.get(key(line), ())
            largest = max((x for x in found if x is not None), default=None)
            if len(found) < min_docs or i == largest:
                kept.append(line)
        out.append((len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def mixed(rows: list[tuple], weights: dict, seed: int, count) -> list[tuple]:
    """(id, copy, order) of (id, source, text) rows; `count` inverts the Poisson distribution."""
    u = lambda *parts: int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / 16**13
    size = defaultdict(int)
    for _, source, text in rows:
        size[source] += len((text or "").encode())
    total, all_weight = sum(size.values()), sum(w for s, w in weights.items() if s in size)
    out = []
    for i, source, text in rows:
        rate = float(total) * weights.get(source, 0) / all_weight / size[source] if size[source] else 0
        parts = max(1, math.ceil(rate / 500))
        n = sum(count(rate / parts, u(seed, i, text, p + 1)) for p in range(parts)) if rate else 0
        out += [(i, c, u(f"order {seed}", i, text, c)) for c in range(1, n + 1)]
    return out


def vectors(ids: list, rows: list, cosine: float = 0.95) -> list[tuple]:
    """(links, smallest id reachable) per vector."""
    fine = []
    for v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        norm = math.sqrt(sum(x * x for x in v)) if ok else 0
        fine.append([x / norm for x in v] if ok else None)
    groups, links = Groups(len(ids)), [0] * len(ids)
    for i, a in enumerate(fine):
        for j in range(i):
            b = fine[j]
            if a and b and len(a) == len(b) and sum(x * y for x, y in zip(a, b, strict=True)) >= cosine:
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    least = {}
    for i, x in enumerate(ids):
        r = groups.root(i)
        least[r] = min(least.get(r, x), x, key=by_id)
    return [(links[i], least[groups.root(i)]) for i in range(len(ids))]


def tokenized(texts: list) -> list:
    """(ids and byte ends by A, the same by B) of space + text, straight from both libraries."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
    out = []
    for text in texts:
        whole = " " + (text or "")
        a = slow.encode(whole, add_special_tokens=False).ids
        b = pieces.encode(text or "")
        bytes_a = [bytes(code[c] for c in slow.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != whole.encode() or b"".join(bytes_b) != whole.encode():
            out.append(([], [], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 400 else _ends(parts)
        out.append((a, ends(bytes_a), b, ends(bytes_b)))
    return out


def _ends(parts: list) -> list:
    total, out = 0, []
    for p in parts:
        total += len(p)
        out.append(total)
    return out


def alignment(texts: list) -> list[tuple]:
    """(n_a, n_b, groups, links, best links, sum of counts, hash, pairs within groups) per text."""
    rows, counts = [], Counter()
    for a, ends_a, b, ends_b in tokenized(texts):
        joint = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a.index(e)], b[ends_b.index(e)]) for e in joint] if len(a) < 400 else None
        if links is None:
            at_a, at_b = dict(zip(ends_a, a, strict=True)), dict(zip(ends_b, b, strict=True))
            links = [(at_a[e], at_b[e]) for e in joint]
        counts.update(links)
        sides, within, low = [], 0, 0
        by_end = [defaultdict(list), defaultdict(list)]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            k = 0
            for token, end in zip(ids, ends, strict=True):
                while joint[k] < end:
                    k += 1
                by_end[side][k].append(token)
        for k in range(len(joint)):
            left, right = by_end[0][k], by_end[1][k]
            sides.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            within += len(left) * len(right)
        rows.append((len(a), len(b), len(joint), links, sha(";".join(sides).encode()) if a else "", within))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [
        (na, nb, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), text, within)
        for na, nb, g, links, text, within in rows
    ]


def text_words(text: str) -> list[str]:
    """Words in lower case: ideographs and kana one by one, others in pieces of 16 letters or digits."""
    out = []
    for run in re.findall(r"[^\W_]+", text.lower()):
        for part in re.findall("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]|[^\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+", run):
            out += [part[i : i + 16] for i in range(0, len(part), 16)]
    return out


def common_words(texts: list[str], parts: int = 400) -> set[str]:
    counts = Counter(w for t in texts for w in text_words(t))
    return {w for w, n in counts.items() if n * parts >= counts.total()}


def spots(text: str, anchors: set[str], gap: int = 6) -> set[tuple]:
    """(anchor or None, two content words after it) wherever a chain starts; equal ones are numbered."""
    words, out, since = text_words(text), [], 0
    for i, w in enumerate(words):
        since = 0 if w in anchors else since + 1
        if w in anchors or i == 0 or since % gap == 0:
            rest = [x for x in words[i:] if x not in anchors][:2]
            if rest:
                out.append((w if w in anchors else None, *rest))
    out = out or [tuple(words[i : i + 3]) for i in range(len(words))]
    return {(x, k) for x, n in Counter(out).items() for k in range(n)}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def spelling(ids: list, texts: list, every: int = 199) -> list[tuple]:
    """(word, form, root, n, near words, form's n) of all words of a corpus."""
    import zlib

    counts: Counter = Counter()
    for i, text in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = sorted({c for w in counts for c in w})
    near = {}
    for w in counts:
        found = {w[:k] + w[k + 1 :] for k in range(len(w))}
        found |= {w[:k] + c + w[k + x :] for k in range(len(w) + 1) for c in letters for x in (0, 1)}
        near[w] = sorted((found & counts.keys()) - {w}, key=lambda v: (-counts[v], v))
    form = {w: near[w][0] if near[w] and counts[near[w][0]] >= 5 * n else None for w, n in counts.items()}
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def letter_words(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of words: a letter and the letters and marks after it."""
    found, inside = [], False
    for i, c in enumerate(text or ""):
        letter = c.isalpha()
        if letter and not inside:
            found.append([i, i])
        inside = letter or (inside and unicodedata.category(c)[0] == "M")
        if inside:
            found[-1][1] = i + 1
    return [tuple(w) for w in found]


def triple_bucket(before: int, at: int, after: int) -> int:
    """The hashed place of three code points (0 outside a word)."""
    full = (1 << 64) - 1
    x = (before * 0x9E3779B97F4A7C15 + at * 0xC2B2AE3D27D4EB4F) & full
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 + after * 0x165667B19E3779F9) & full
    return (((x ^ (x >> 32)) * 0x94D049BB133111EB) & full) >> 48


def language_scores(text: str, model, script_of) -> list[list[float]]:
    """Per word and language the score of the word's triples; other scripts as the worst and 16 less."""
    out = []
    for start, end in letter_words(text):
        code = [0, *(ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text[start:end]), 0]
        scores = [0.0] * len(model.languages)
        for i in range(1, len(code) - 1):
            row = model.scores[triple_bucket(*code[i - 1 : i + 2])]
            scores = [a + float(b) for a, b in zip(scores, row, strict=True)]
        known = model.scripts[script_of(code[1])]
        if known.any():
            worst = min(scores)
            scores = [s if k else worst - 16.0 for s, k in zip(scores, known, strict=True)]
        out.append(scores)
    return out


def best_path(scores: list[list[float]], penalty: float) -> float:
    """The score of the best sequence of languages, tried one word after another."""
    best = list(scores[0])
    for word in scores[1:]:
        best = [
            max(b - (penalty if j != i else 0.0) for j, b in enumerate(best)) + s for i, s in enumerate(word)
        ]
    return max(best)
