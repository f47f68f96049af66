"""Plain Python versions of the pipeline's operators, for small tables: no hashing, no index, every pair compared."""

import hashlib

import regex
import xxhash


WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


#: Written out here, apart from the operator's own.
FURNITURE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under", "privacy policy", "released under the", "subscribe to our", "terms of service", "terms of use",
    "alle rechte vorbehalten", "hier klicken", "cookie-richtlinie", "datenschutzerklärung", "lizenziert unter", "nutzungsbedingungen",
    "tous droits réservés", "cliquez ici", "politique de confidentialité", "conditions générales", "sous licence",
    "todos los derechos reservados", "haga clic aquí", "política de privacidad", "términos de uso", "bajo licencia",
)
END_MARKS = ".!?:;…\"'”’»)]}。！？؟।"


def has_end(text):
    text = text.rstrip(" \t\n\x0b\x0c\r")
    return bool(text) and text[-1] in END_MARKS


def line_fails(line, paragraph):
    if not words(line):
        return False
    parts, chars = len(line.split(" ")), sum(map(len, words(line)))
    letters, capitals = len(regex.findall(r"\p{L}", line)), len(regex.findall(r"\p{Lu}", line))
    return (
        len(regex.findall(r"[!?]{2,}|\.{4,}", line)) * 3 > parts
        or len(regex.findall(r"[#*$%&|<>]", line)) * 10 > chars
        or (letters >= 10 and capitals * 10 > letters * 7)
        or len(regex.findall(r" [|>»·] ", line)) >= 3
        or any(p in " " + line.lower() and regex.search(r"(?<!\p{L})" + regex.escape(p), line.lower()) for p in FURNITURE)
        or (parts >= 5 and not has_end(line) and not has_end(paragraph))
    )


def judged(t):
    """(kept, text without failing lines)."""
    t = t or ""
    w = words(t)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)}
    good = [x for p in regex.split(r"\n(?!\p{Ll})", t) for x in p.split("\n") if not line_fails(x, p)]
    size = lambda lines: sum(len(x) for s in lines for x in words(s))
    kept = len(w) >= 10 and 100 * len(covered) <= 20 * len(w) and (size([t]) - size(good)) * 100 <= 50 * size([t])
    return kept, "\n".join(good)


def copied_runs(docs):
    """{(doc_id, text): [(start, length)]}: maximal runs of lines that stand earlier too; of two lines with words, or one line of 20 words."""
    order = sorted({(d, t) for d, t in docs if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, text_key(r[1])))
    lines = [t.split("\n") for _, t in order]
    at = {}
    out = {}
    for n, own in enumerate(lines):
        runs = []
        for i, x in enumerate(own):
            best = 0
            for m, j in at.get(x, ()):
                k = 0
                while i + k < len(own) and j + k < len(lines[m]) and own[i + k] == lines[m][j + k]:
                    k += 1
                best = max(best, k)
            if best < 2 or not any(words(y) for y in own[i : i + best]):
                best = int(best > 0 and len(words(x)) >= 20)
            if best and (not runs or i + best > sum(runs[-1])):
                runs.append((i, best))
            at.setdefault(x, []).append((n, i))
        out[order[n]] = runs
    return out


def without_copied_lines(docs):
    """docs: (doc_id, text) in any order; {(doc_id, text): (n_lines, n_removed, kept text)}."""
    out = {(d, t): (0, 0, "") for d, t in docs if t is None}
    for (d, t), runs in copied_runs(docs).items():
        lines = t.split("\n")
        gone = {i for start, length in runs for i in range(start, start + length)}
        out[d, t] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
    return out


def shingles(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets, percent):
    """Least index reachable over pairs of sets that are similar enough."""
    best = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(best[i], best[j])
            changed |= (best[i], best[j]) != (low, low)
            best[i] = best[j] = low
    return best


def tokens(t):
    return [x for w in words((t or "").lower()) if (x := regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w))]


def leaked(t, item, window=16, percent=80, shortest=6):
    """Whether a stretch of the item agrees with the text on some diagonal."""
    a, b = tokens(t), tokens(item)
    if len(b) < shortest:
        return bool(b) and a == b
    width = min(window, len(b))
    for diagonal in range(-len(b) + 1, len(a)):
        same = [a[diagonal + k] == x for k, x in enumerate(b) if 0 <= diagonal + k < len(a)]
        if any(sum(same[i : i + width]) * 100 >= percent * width for i in range(max(1, len(same) - width + 1))):
            return True
    return False


def text_key(t):
    """xxhash64 of a text, as Spark gives it (signed)."""
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def row_hash(doc_id, t):
    """The first 40 bits of an MD5 digest of doc_id and text."""
    return int(hashlib.md5(":".join([*([] if doc_id is None else [str(doc_id)]), t or ""]).encode()).hexdigest()[:10], 16)


def targets(sizes, weights=(5, 2, 1)):
    """Shares by weight, cut off at twice the size and shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        level = (total - sum(done.values())) / max(1e-9, sum(w[s] for s in free)) if free else 0
        over = [s for s in free if w[s] * level > 2 * sizes[s]]
        if not over:
            return done | {s: w[s] * level for s in free}
        done |= {s: 2.0 * sizes[s] for s in over}


def mixed(docs):
    """docs: (doc_id, text, source); {(doc_id, text, source): taken}: documents in the order of their hash up to the target."""
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    out = {}
    for s, target in targets(sizes).items():
        own = sorted((row_hash(d, t), len(words(t)), d, t) for d, t, x in docs if x == s)
        base = int(target // sizes[s]) if sizes[s] else 0
        left, open_ = target - base * sizes[s], base < 2
        for _, n, d, t in own:
            takes = open_ and (n <= left or n < 2 * left)
            open_ &= n <= left
            left -= n
            out[d, t, s] = n * (base + takes)
    return out
