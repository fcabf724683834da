"""The operators in plain Python, for small inputs."""

import hashlib
import re
import zlib

import numpy as np
import xxhash


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def components(nodes, linked):
    """Smallest node reachable, per node."""
    found = {}
    for start in sorted(nodes):
        if start in found:
            continue
        stack = [start]
        while stack:
            n = stack.pop()
            if n not in found:
                found[n] = start
                stack += [m for m in nodes if m not in found and linked(n, m)]
    return found


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def base_spans(text):
    assign = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    text = text or ""
    found = [("assign", *m.span()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def without_repeats(docs, window=50):
    """{index: (bytes, removed, spans, digest)} of [(doc_id, text)]."""
    first = {}
    texts = [((-1 << 63) if d is None else d, (t or "").encode()) for d, t in docs]
    for doc, text in texts:
        for p in range(len(text) - window + 1):
            w = text[p : p + window]
            first[w] = min(first.get(w, doc), doc)
    found = []
    for doc, text in texts:
        mark = bytearray(len(text))
        for p in range(len(text) - window + 1):
            if first[text[p : p + window]] < doc:
                mark[p : p + window] = b"\1" * window
        kept = bytes(c for c, m in zip(text, mark) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        found.append((len(text), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return found


def links(rows, least=0.98):
    """{vec_id: (links, component)} of [(vec_id, vector, label)] with different ids."""
    unit = {}
    for i, v, label in rows:
        a = None if v is None or any(x is None for x in v) else np.array(v, float)
        if a is not None and label is not None and np.isfinite(a).all() and a.any():
            unit[i] = (label, a / np.linalg.norm(a))

    def linked(i, j):
        if i not in unit or j not in unit or i == j:
            return False
        (x, a), (y, b) = unit[i], unit[j]
        return x == y and len(a) == len(b) and a @ b >= least

    ids = [i for i, _, _ in rows]
    root = components(ids, linked)
    return {i: (sum(linked(i, j) for j in ids), root[i]) for i in ids}


def token_pieces(docs, tokenizer, capacity=2048):
    found = {}
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for no, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            found[doc, no] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return found


def alignments(docs):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] of [text], token by token and pair by pair."""
    import public_tokenizers
    import sentencepiece
    from collections import Counter
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in printable}
    byte |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printable)}

    def groups(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        of_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
        raw = (" " + text).encode()
        if not text or b"".join(of_a) != raw or b"".join(of_b) != raw:
            return []
        found, i, j, x, y = [([], [])], 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if x <= y and i < len(ids_a):
                found[-1][0].append(ids_a[i])
                x += len(of_a[i])
                i += 1
            else:
                found[-1][1].append(ids_b[j])
                y += len(of_b[j])
                j += 1
            if x == y:
                found.append(([], []))
        return found[:-1]

    every = [groups(t or "") for t in docs]
    links = [Counter((x, y) for p, q in g for x in p for y in q) for g in every]
    count = Counter(k for found in links for k in found)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for g, found in zip(every, links):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        best = sum(n for k, n in found.items() if count[k] == most[k[0]])
        total = sum(n * count[k] for k, n in found.items())
        sizes = [sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(found.values())]
        rows.append((*sizes, best, total, hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return rows


def whitened(rows, components=16, weigh=lambda copies: 1):
    """(n, {vec_id: (deviation, projections)}, explained) of [(vec_id, vector)], vectors of one length, by numpy on all at once."""
    from collections import Counter
    from math import floor, isfinite

    x = {i: tuple(floor(64 * c) + 1_000_000 for c in v) for i, v in rows if v is not None and all(c is not None and isfinite(c) for c in v)}
    copies = Counter(x.values())
    fit = np.array(list(copies), float)
    w = np.array([weigh(c) for c in copies.values()], float)
    n = int(w.sum())
    sums = [int(sum(int(v) * int(k) for v, k in zip(column, w))) for column in zip(*copies)]
    mean = np.array([s / n for s in sums])
    values, axes = np.linalg.eigh((fit - mean).T @ ((fit - mean) * w[:, None]) / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = ((fit - mean) ** 2 * w[:, None]).sum() / n
    found = {}
    for i, v in x.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        found[i] = (deviation, (np.array(v, float) - mean) @ axes / np.sqrt(np.maximum(values, 1e-300)))
    return n, found, values / trace


def context_ratios(rows, discount):
    """{word: log P(word | toxic) - log P(word | ordinary)} of [(text, toxic)]: Kneser-Ney counts of contexts with one backoff."""
    from math import log

    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", lowered(t).encode())
    seen = [{}, {}]
    for text, toxic in rows:
        words = split(text)
        for left, word in zip([None, *words], words):
            seen[toxic].setdefault(word, set()).add(left)
    every = {w: seen[0].get(w, set()) | seen[1].get(w, set()) for w in {*seen[0], *seen[1]}}
    total = [sum(len(c) for c in of.values()) for of in seen]
    kept = [sum(max(len(c) - discount, 0) for c in of.values()) / max(n, 1) for of, n in zip(seen, total)]
    backoff = min(1.0, max(1 - k for k in kept))
    mass = sum(len(c) for c in every.values()) + 0.5 * (len(every) + 1)

    def p(k, word):
        own = max(len(seen[k].get(word, ())) - discount, 0) / max(total[k], 1) / max(kept[k], 1e-12)
        return own * (1 - backoff) + (len(every[word]) + 0.5) / mass * backoff

    return {w: log(p(1, w) / p(0, w)) for w in every}
