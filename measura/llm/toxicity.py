"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Kernel: two letter strings are compared by their common subsequences of three letters; an occurrence that spans L letters
weighs ``decay ** L``, spans over ``span`` letters weigh nothing, and the kernel is normalized. Gapped or padded insults
keep most of their subsequences. A document is scored by its most insult-like token: letters only, digits and signs that
stand for letters read as those, other signs dropped, so ``i-d-i.o_t`` is one token; three or more single letters in a row
("i d i o t") are read as one token as well. No other neighbours are joined and no sentences are formed.

Training texts carry their document's label. A token seen in clean texts is negative; the witness of a toxic
document is its highest-scoring token that no clean document has, found in rounds (multiple-instance SVM), in which the clean tokens
that score highest become weighty negatives. Witnesses with inserted letters are added as virtual examples. Landmarks are spread over witnesses and clean tokens; the SVM is linear in
the Nyström features K(x, L) K(L, L)^-1/2. As K(x, L) is linear in the subsequence weights of x, the trained machine is
folded into one weight per subsequence, and scoring costs one table look-up each.

Defined cases: null and empty texts, and texts without letters, get the score of no evidence, below 0.5. Texts are read whole.
Repeated rows get equal scores. Without labelled rows of both kinds every score is 0. An empty table gives no rows. Other
columns pass through ``flag_toxic`` untouched; ``score_toxicity`` reads id and text only.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, fold_of, sample_share, words_of

#: Signs read as letters inside a token.
LEET = str.maketrans("013457@$", "oieastas")
SYMBOLS = 40  # letter classes: a-z are 1 to 26, all others share 27 to 39
EDGE = 96  # stands before and behind each token


@dataclass
class Machine:
    """weights: one per subsequence code; score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    decay: float
    span: int

    def margins(self, tokens: list[str]) -> np.ndarray:
        row, code, weight = subsequences(tokens, self.decay, self.span)
        return np.bincount(row, weights=weight * self.weights[code], minlength=len(tokens)) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def letters(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all tokens in one array, and the token of each letter."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    code = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    plain = (code >= 97) & (code <= 122)
    return np.where(plain, code - 96, np.where(code == EDGE, 0, 27 + code % 13)), np.repeat(np.arange(len(tokens)), size)


def subsequences(tokens: list[str], decay: float, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, code, weight) of every three-letter subsequence within ``span`` letters, each code once per token, weights of
    unit length per token. Two letters are padded by an edge sign, so short tokens have some too."""
    letter, owner = letters([f"{chr(EDGE)}{t}{chr(EDGE)}" for t in tokens])
    rows, codes, weights = [], [], []
    for a in range(1, span - 1):
        for b in range(a + 1, span):
            if len(letter) <= b:
                continue
            same = owner[:-b] == owner[b:]
            first, mid, third = letter[:-b][same], letter[a:len(letter) - b + a][same], letter[b:][same]
            rows.append(owner[:-b][same])
            codes.append((first * SYMBOLS + mid) * SYMBOLS + third)
            weights.append(np.full(len(first), decay ** (b + 1)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, code, weight = np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)
    key, where = np.unique(row * SYMBOLS ** 3 + code, return_inverse=True)
    weight = np.bincount(where, weights=weight, minlength=len(key))
    row, code = key // SYMBOLS ** 3, key % SYMBOLS ** 3
    norm = np.sqrt(np.bincount(row, weights=weight ** 2, minlength=len(tokens)))
    return row, code, weight / norm[row]


def kernel(tokens: list[str], landmarks: list[str], decay: float, span: int) -> np.ndarray:
    """K(tokens, landmarks)."""
    row, code, weight = subsequences(landmarks, decay, span)
    known, place = np.unique(code, return_inverse=True)
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)  # the last row is for codes that no landmark has
    table[place, row] = weight
    at = np.full(SYMBOLS ** 3, len(known), np.int32)
    at[known] = np.arange(len(known))
    out = np.zeros((len(tokens), len(landmarks)), np.float32)
    for start in range(0, len(tokens), 2_048):  # the tokens' subsequences are never all in memory
        row, code, weight = subsequences(tokens[start:start + 2_048], decay, span)
        for a in range(0, len(row), 1 << 15):
            part = slice(a, a + (1 << 15))
            edges = np.flatnonzero(np.diff(row[part], prepend=-1))
            out[start + row[part][edges]] += np.add.reduceat(table[at[code[part]]] * weight[part, None].astype(np.float32), edges)
    return out


def token_key(words: pa.Array) -> pa.Array:
    """Lower-case letters of each word, look-alike signs read as letters when letters stand beside them."""
    lower = pc.utf8_lower(words)
    odd = pc.match_substring_regex(lower, r"[^a-z\x{80}-\x{10FFFF}]")
    if not pc.any(odd).as_py():
        return lower
    some = lower.filter(odd)
    edge = pc.replace_substring_regex(some, r"^[^\pL@$0-9]+|[^\pL]+$", "")
    # A sign between letters stands for a letter; other signs go.
    for sign, letter in zip("013457@$", "oieastas"):
        sign = "\\" + sign if sign == "$" else sign
        edge = pc.replace_substring_regex(edge, rf"(\pL){sign}(\pL)", rf"\1{letter}\2")
    return pc.replace_with_mask(lower, odd, pc.replace_substring_regex(edge, r"[^\pL\pM]+", ""))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The row of each token, and the tokens; runs of three or more single letters come once more as one token."""
    rows, words = words_of(pc.fill_null(column, ""))
    coded = words.dictionary_encode()
    keys = token_key(coded.dictionary)
    index = np.asarray(coded.indices)
    if len(index):
        one = np.asarray(pc.equal(pc.utf8_length(keys), 1))[index]
        if one.any():
            run = np.flatnonzero(one)
            part = np.cumsum(np.concatenate([[0], (np.diff(run) != 1) | (np.diff(rows[run]) != 0)]).astype(np.int64))
            long = np.flatnonzero(np.bincount(part) >= 3)
            if len(long):
                names, bounds = keys.to_pylist(), np.searchsorted(part, np.stack([long, long + 1]))
                joined = ["".join(names[index[k]] for k in run[a:b]) for a, b in bounds.T]
                rows = np.concatenate([rows, rows[run[bounds[0]]]])
                index = np.concatenate([index, len(keys) + np.arange(len(joined))])
                keys = pa.concat_arrays([keys, pa.array(joined, keys.type)])
    return rows, pa.DictionaryArray.from_arrays(pa.array(index.astype(np.int32)), keys)


def document_margins(column: pa.Array, machine: Machine) -> np.ndarray:
    """The highest token margin of each text; -inf without tokens."""
    best = np.full(len(column), -np.inf)
    rows, coded = tokens_of(column)
    if not len(rows):
        return best
    unique = coded.dictionary.dictionary_encode()  # several words can have one key
    names = unique.dictionary.to_pylist()
    margin = np.concatenate([machine.margins(names[a:a + 8_192]) for a in range(0, len(names), 8_192)])
    margin[[k for k, x in enumerate(names) if len(x) < 3]] = -np.inf
    each = margin[np.asarray(unique.indices)][np.asarray(coded.indices)]
    np.maximum.at(best, rows, each)
    return best


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the rows inside the margin."""
    x = np.empty((len(z), z.shape[1] + 1), np.float32)  # summed in double precision, block by block
    x[:, :-1], x[:, -1] = z, 1
    blocks = [slice(a, a + 2_048) for a in range(0, len(x), 2_048)]
    ridge = np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-8
    w = np.zeros(x.shape[1])

    def margins(v: np.ndarray) -> np.ndarray:
        return np.concatenate([x[b].astype(float) @ v for b in blocks])

    def loss(v: np.ndarray) -> float:
        return float(v @ ridge @ v + weight @ np.maximum(0, 1 - y * margins(v)) ** 2)

    now = loss(w)
    for _ in range(steps):
        inside = np.where(y * margins(w) < 1, np.sqrt(weight), 0)
        square, right = ridge.copy(), np.zeros(x.shape[1])
        for b in blocks:
            a = x[b] * inside[b, None]
            square += a.T @ a
            right += a.T @ (y[b] * inside[b])
        step = np.linalg.solve(square, right) - w
        size, new = 1.0, loss(w + step)
        while new > now - 1e-4 * size * abs(now) and size > 1e-3:
            size, new = size / 2, loss(w + size / 2 * step)
        if now - new < 1e-6 * now:
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])


def _spread(names: list[str], most: int, decay: float, span: int) -> list[str]:
    """Names far from each other: each next one is the least similar to those taken."""
    if len(names) <= most:
        return names
    k = np.hstack([kernel(names, names[a:a + 256], decay, span) for a in range(0, len(names), 256)])
    taken, near = [0], k[0].copy()
    while len(taken) < most:
        taken.append(int(np.argmin(near)))
        near = np.maximum(near, k[taken[-1]])
    return [names[i] for i in taken]


def _padded(token: str) -> list[str]:
    """The token with one letter put in, at each inner place, and with each inner letter doubled."""
    inner = range(1, len(token))
    return [token[:k] + "exiuh"[k % 5] + token[k:] for k in inner] + [token[:k] + token[k - 1] + token[k:] for k in inner]


def train(sentences: list[tuple[int, list[str]]], decay: float = 0.8, span: int = 5, landmarks: int = 256, rounds: int = 3,
          penalty: float = 0.003, odds: float = 1e5, variants: int = 150, most_negative: int = 20_000) -> Machine | None:
    """sentences: (label, tokens) of labelled texts. None without both labels. A token that only toxic documents have is
    a witness without further proof if chance explains that with less than one in ``odds``; near copies of a document count
    once. The ``variants`` most frequent witnesses get virtual examples; ``most_negative`` bounds the clean tokens that are negatives."""
    clean: Counter = Counter()
    toxic: Counter = Counter()
    sentences = [(y, sorted({x for x in t if len(x) >= 3})) for y, t in sentences]
    unlike = _without_near_copies(sentences)
    for label, tokens in unlike:
        (toxic if label else clean).update(tokens)
    clean.update(sorted({x for y, t in sentences if not y for x in t if x not in clean}))  # a set's order differs from run to run
    positives = [t for y, t in sentences if y]
    if not positives or len(positives) == len(sentences) or not clean:
        return None
    only = {t: n for t, n in toxic.items() if t not in clean}
    least = np.log(odds) / np.log(len(sentences) / len(positives))
    stem = Counter()  # the same by the first four letters, for insults that come in many endings
    for y, tokens in unlike:
        stem.update({(y, t[:4]) for t in tokens if len(t) > 5})
    known = Counter({t: n for t, n in only.items() if n >= least or len(t) > 5 and stem[1, t[:4]] >= least and not stem[0, t[:4]]}) or Counter(dict(Counter(only).most_common(20)))
    own = [[t for t in set(tokens) if t in only] for tokens in positives if not any(t in known for t in tokens)]
    negatives = [t for t, _ in clean.most_common()]
    rng = np.random.default_rng(0)
    if len(negatives) > most_negative:  # all frequent ones and an even choice of the rest
        half = most_negative // 2
        negatives = negatives[:half] + [negatives[i] for i in half + rng.choice(len(negatives) - half, most_negative - half, replace=False)]
    machine, before, hard = None, None, []
    for turn in range(rounds):
        witness = Counter(known)
        if machine is not None:
            names = sorted({t for c in own for t in c})
            score = dict(zip(names, machine.margins(names))) if names else {}
            witness |= Counter(t for t in (max(c, key=lambda t: (score[t], t)) for c in own if c) if score[t] > 0)
        if turn > 1 and witness == before:
            break
        before = witness
        found = [t for t, _ in witness.most_common(3_000)]
        extra = [x for t in found[:variants] for x in _padded(t) if x not in clean]
        tokens = found + extra + negatives + hard
        y = np.concatenate([np.ones(len(found) + len(extra)), -np.ones(len(negatives) + len(hard))])
        count = np.array([witness[t] for t in found] + [1] * len(extra) + [clean[t] for t in negatives] + [100] * len(hard), float)
        weight = np.sqrt(count)
        weight[y > 0] *= .5 * weight[y < 0].sum() / weight[y > 0].sum()
        weight *= len(y) / weight.sum() / 10
        quarter = landmarks // 4
        chosen = found[:quarter] + _spread(found[:1_500], quarter, decay, span) + negatives[:quarter] + _spread(negatives[:1_500], quarter, decay, span)
        chosen = list(dict.fromkeys(chosen + hard[:quarter // 2]))
        kmm = kernel(chosen, chosen, decay, span).astype(float)
        value, vector = np.linalg.eigh(kmm)
        root = vector / np.sqrt(np.maximum(value, 1e-4)) @ vector.T
        w, bias = _svm(kernel(tokens, chosen, decay, span) @ root.astype(np.float32), y, weight, penalty)
        row, code, amount = subsequences(chosen, decay, span)
        weights = np.bincount(code, weights=amount * (root @ w)[row], minlength=SYMBOLS ** 3)
        machine = Machine(weights, bias, 4.0, 0.0, decay, span)
        # A clean document's best token must stay below a toxic one's: the cut lies between.
        names = sorted({t for _, tokens in sentences for t in tokens})
        margin = dict(zip(names, np.concatenate([machine.margins(names[a:a + 8_192]) for a in range(0, len(names), 8_192)]).tolist()))
        hard = sorted((t for t in names if t in clean), key=margin.__getitem__, reverse=True)[:1_000]  # the next turn's hardest negatives
        top = np.array([max(map(margin.__getitem__, tokens), default=-2.) for _, tokens in sentences])
        label = np.array([y for y, _ in sentences])
        cut = _best_cut(top, label)
        machine.bias -= cut
    return machine


def _without_near_copies(sentences: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """One of the documents that share two of their three smallest token hashes under some of four hash orders."""
    seen: set = set()
    out = []
    for label, tokens in sentences:
        h = np.array([zlib.crc32(t.encode("utf-8", "replace")) for t in tokens], np.uint64)
        keys = set()
        for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)):
            low = np.sort(h * np.uint64(m) % np.uint64(1 << 32))[:3].tolist()
            keys |= {(label, k, *low[:2]), (label, k, *low[1:]), (label, k, *low[::2])} if len(low) == 3 else {(label, k, *low)}
        if not keys & seen:
            out.append((label, tokens))
        seen |= keys
    return out


def _best_cut(top: np.ndarray, label: np.ndarray) -> float:
    """The cut with the fewest errors, false alarms counting double; two fifths into the widest such gap, as insults in
    disguise score lower than the plain ones of the sample."""
    order = np.argsort(top)
    s, y = top[order], label[order]
    below = np.concatenate([[0], np.cumsum(y)])  # toxic texts below
    above = np.concatenate([[0], np.cumsum((1 - y)[::-1])])[::-1]  # clean texts above
    cost = below + 2 * above
    edge = np.concatenate([[s[0] - .2], s, [s[-1] + .2]])
    gaps = [(edge[k + 1] - edge[k], k) for k in np.flatnonzero(cost == cost.min())]
    _, k = max(gaps)
    return float(edge[k] + 0.4 * (edge[k + 1] - edge[k]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        folds: int = 5, most_toxic: int = 2_000, most_clean: int = 5_000) -> Machine | None:
    """Train on a bounded sample: at most ``most_toxic`` and ``most_clean`` labelled texts outside fold 0, picked by id hash."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y in (0, 1)").where(fold_of("i", folds) != 0)
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    taken = [sample_share(known.where(F.col("y") == y), "i", most / max(1, n.get(y, 0)), most) for y, most in ((1, most_toxic), (0, most_clean))]
    chosen = F.broadcast(taken[0].unionByName(taken[1]).distinct())  # bounded by the two parameters
    rows = texts.join(chosen, "i").select("y", "t").mapInArrow(_distinct_tokens, "y int, tokens array<string>")
    # The bounded sample is trained on in one task: what that takes the driver would not give back for the steps that follow.
    found = rows.repartition(1).mapInArrow(_trained, "weights binary, bias double, slope double, shift double, decay double, span int").first()
    return None if found is None else Machine(np.frombuffer(bytes(found.weights)), *found[1:])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The machine of all (label, tokens) as one row; none if ``train`` gives none."""
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    tokens = pc.list_flatten(rows["tokens"]).combine_chunks().dictionary_encode()
    names = np.array(tokens.dictionary.to_pylist(), object)  # one string for all its occurrences
    ends = np.cumsum(np.asarray(pc.list_value_length(rows["tokens"])))
    parts = np.split(np.asarray(tokens.indices), ends[:-1]) if len(ends) else []
    order = sorted(range(len(parts)), key=lambda k: (rows["y"][k].as_py(), names[parts[k]].tolist()))
    machine = train([(rows["y"][k].as_py(), names[parts[k]].tolist()) for k in order])
    if machine is not None:
        values = [machine.weights.tobytes(), float(machine.bias), machine.slope, machine.shift, machine.decay, machine.span]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.binary(), *[pa.float64()] * 4, pa.int32()))], ["weights", "bias", "slope", "shift", "decay", "span"])


def _distinct_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, n in by_bytes(batch.column(1), 8 << 20):
            part = batch.slice(a, n)
            rows, coded = tokens_of(part.column(1))
            pairs = defaultdict(set)
            for r, t in zip(rows.tolist(), coded.cast(coded.type.value_type).to_pylist()):
                pairs[r].add(t)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array([sorted(pairs[k]) for k in range(n)], pa.list_(pa.string()))], ["y", "tokens"])


def _scores(machine: Machine | None, text_at: int, append: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in by_bytes(batch.column(text_at), 8 << 20):
                part = batch.slice(a, n)
                score = np.zeros(n)
                if machine is not None:
                    margin = document_margins(part.column(text_at), machine)
                    score = machine.probability(np.where(np.isfinite(margin), margin, -1.5))
                more = {"score": pa.array(score), "predicted": pa.array((score >= .5).astype(np.int32))}
                yield pa.RecordBatch.from_arrays([*part.columns, *(more[k] for k in append)], names=[*part.schema.names, *append])

    return run


def score_toxicity(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """id, held_out, score, predicted for every row."""
    rows = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("i"))
    out = rows.mapInArrow(_scores(machine, 0, ["score", "predicted"]), f"t string, i {rows.schema['i'].dataType.simpleString()}, score double, predicted int")
    return out.select(F.col("i").alias(id_col), (fold_of("i", folds) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, machine: Machine | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all their columns kept."""
    at = docs.columns.index(text_col)
    renamed = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    schema = T.StructType([*renamed.schema.fields, T.StructField("predicted", T.IntegerType())])
    return renamed.mapInArrow(_scores(machine, at, ["predicted"]), schema).where("predicted = 0").drop("predicted").toDF(*docs.columns)
