"""Toxicity by a counterfactually regularised classifier.

A text is the set of its words, of the first bytes of its longer words, and of
those beginnings that two of its words or more share, so that inflected or
compound words of one stem count together; each is a slot of a hashed
vocabulary.  A first logistic fit with an L1 penalty picks the words that labels
depend on, a second one on these alone has an L2 penalty instead.  Both take each
labelled sentence that names a group, swap the identity term for the other ones
of its kind (and for none), and penalise the squared change of the score.  So
mentioning a group moves no score unless the words around it do.  Terms are words
alone in four languages; that training never saw has no weight at all.

The fit is on a bounded sample: the `most` labelled rows with the smallest hash
of their id.  Only their slots reach the driver.  Scoring is one pass over all
texts that looks at the slots with a weight alone.

Null, empty and other texts without words get the base rate; a long text is one set
of words like any other.  Equal texts get equal scores.  Rows with the same id are
scored one by one; labels that disagree for an id count by their mean (0.5 is
toxic), null labels not at all.  With no labels, or none of one kind, the score
is the rate seen (0 without labels, but for rounding).  An empty table gives an empty one.  All columns are kept; one with
the name of the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import exchange as X
from factweave.llm.textops import ALNUM, LOWER, U, flat, hashed_words, isin_sorted, mix, owner, pieces, prefix_sums, spans, word_hashes, words

BITS = 22
SLOTS = 1 << BITS
#: Lengths of the beginnings of words, in bytes.
STEMS = (4, 6)

# Identity terms that are swapped for each other, by kind, in English, German, French and Spanish.
IDENTITY_TERMS = {
    "gender": """woman women man men girl girls boy boys female females male males transgender trans nonbinary
        frau frauen mann männer mädchen junge jungen weiblich weibliche weiblichen männlich männliche männlichen
        femme femmes homme hommes fille filles garçon garçons féminin féminine masculin masculine transgenre transgenres
        mujer mujeres hombre hombres niña niñas niño niños chica chicas chico chicos femenino femenina masculino masculina transgénero""",
    "religion": """muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists sikh sikhs atheist atheists catholic catholics
        moslem moslems muslime muslimin muslimische christ christen christin christliche jude juden jüdin jüdisch jüdische hinduistin buddhistin buddhisten atheistin atheisten katholik katholiken katholikin
        musulman musulmans musulmane musulmanes chrétien chrétiens chrétienne chrétiennes juif juifs juive juives hindou hindous bouddhiste bouddhistes athée athées catholique catholiques
        musulmán musulmana musulmanas cristiano cristianos cristiana cristianas judío judíos judía judías hindúes budista budistas ateo ateos atea ateas católico católicos católica católicas""",
    "origin": """african africans american americans asian asians arab arabs european europeans mexican mexicans chinese indian indians turkish black white latino latina immigrant immigrants refugee refugees foreigner foreigners
        afrikaner afrikanerin afrikanische amerikaner amerikanerin amerikanische asiate asiaten asiatin asiatische araber araberin arabische europäer europäerin europäische mexikaner mexikanerin chinesen chinesin inder inderin türke türken türkin türkische schwarze weiße migrant migranten migrantin einwanderer flüchtling flüchtlinge ausländer ausländerin
        africain africains africaine africaines américain américains américaine américaines asiatique asiatiques arabe arabes européen européens européenne européennes mexicain mexicains mexicaine chinois chinoise indien indiens indienne turc turcs turque noir noirs noire noires blanc blancs blanche immigré immigrés immigrée réfugié réfugiés réfugiée étranger étrangers étrangère
        africano africanos africana africanas americano americanos americana americanas asiático asiáticos asiática asiáticas árabe árabes europeo europeos europea europeas mexicano mexicanos mexicana mexicanas chino chinos china chinas indio indios india indias turco turcos turca negro negros negra negras blanco blancos blanca inmigrante inmigrantes refugiado refugiados refugiada extranjero extranjeros extranjera""",
    "orientation": """gay gays lesbian lesbians bisexual bisexuals straight heterosexual heterosexuals homosexual homosexuals queer
        schwul schwule schwulen lesbe lesben lesbisch lesbische bisexuell bisexuelle heterosexuell heterosexuelle homosexuell homosexuelle homosexuellen
        lesbienne lesbiennes bisexuel bisexuels bisexuelle hétérosexuel hétérosexuels homosexuel homosexuels
        lesbiana lesbianas bisexuales heterosexuales homosexuales""",
    "ability": """deaf blind disabled autistic
        taub taube gehörlos gehörlose blinde blinden behindert behinderte behinderten autistisch autistische
        sourd sourds sourde sourdes aveugle aveugles handicapé handicapés handicapée autiste autistes
        sordo sordos sorda sordas ciego ciegos ciega ciegas discapacitado discapacitados discapacitada autistas""",
}


def _terms(terms: list[str]) -> np.ndarray:
    return hashed_words(pa.array(terms), ALNUM, True)[0]


_KINDS = {kind: np.unique(_terms(terms.split())) for kind, terms in IDENTITY_TERMS.items()}
_ALL_TERMS = np.unique(np.concatenate(list(_KINDS.values())))
#: Bytes after which another sentence begins.
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


def slots(column, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each text, once each and in order, and where each text's begin; only wanted ones, if given.

    An identity term is a word alone: its beginning is no feature, or swapping the term would not swap all of it.
    """
    data, off = flat(column)
    data = LOWER[data]
    start, end, first = words(data, off, ALNUM)
    sums, text = prefix_sums(data.astype(U) + U(1)), owner(first).astype(U)
    word = spans(sums, start, end)
    pick = lambda s: np.arange(len(s)) if wanted is None else np.flatnonzero(wanted[s])
    slot = word % U(SLOTS)
    at = pick(slot)
    found = [(text[at] << U(BITS)) | slot[at]]
    plain = ~isin_sorted(word, _ALL_TERMS)
    for n in STEMS:
        long = np.flatnonzero((end - start > n) & plain)
        stem = spans(sums, start[long], start[long] + n)
        slot = mix(stem + U(n)) % U(SLOTS)
        at = pick(slot)
        found.append((text[long[at]] << U(BITS)) | slot[at])
        slot = mix(stem + U(n + 64)) % U(SLOTS)
        at = pick(slot)
        key, own = (text[long[at]] << U(BITS)) | slot[at], word[long[at]]
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        found.append(key[1:][(key[1:] == key[:-1]) & (own[1:] != own[:-1])])
    keys = np.unique(np.concatenate(found))
    return keys & U(SLOTS - 1), np.searchsorted(keys >> U(BITS), np.arange(len(off)).astype(U))


def mentions(column) -> list[bytes]:
    """Of each text, the slots of its identity terms, once for each sentence that has them."""
    data, off = flat(column)
    data = LOWER[data]
    start, end, first = words(data, off, ALNUM)
    word = word_hashes(data, start, end)
    at = np.flatnonzero(isin_sorted(word, _ALL_TERMS))
    sentence = np.cumsum(_ENDS[data])[start[at]] if len(at) else at
    rows = np.unique(np.stack((owner(first)[at], sentence, (word[at] % U(SLOTS)).astype(np.int64)), 1), axis=0)
    cut = np.searchsorted(rows[:, 0], np.arange(len(off)))
    return [rows[cut[i] : cut[i + 1], 2].astype("<u4").tobytes() for i in range(len(off) - 1)]


def sample(docs: DataFrame, labels: DataFrame, most: int, folds: int, held: int) -> list[tuple[int, bytes, bytes]]:
    """(label, slots, identity terms by sentence) of at most `most` labelled rows outside the held fold, by hash of the id."""
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != held))
        .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                held_, first = slots(piece.column(1))
                rows = [held_[first[i] : first[i + 1]].astype("<u4").tobytes() for i in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(rows, pa.binary()), pa.array(mentions(piece.column(1)), pa.binary())], ["doc_id", "label", "slots", "terms"])

    # the ids are bounded by `most`, so they can be broadcast; a row more than `most` only comes from repeated ids
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = found.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, slots binary, terms binary")
    return [(r["label"], bytes(r["slots"]), bytes(r["terms"])) for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", "slots").limit(most).collect()]


class Classifier:
    def __init__(self, bias: float, index: np.ndarray, weight: np.ndarray):
        """index: slots, in order."""
        self.bias, self.index, self.weight = bias, index.astype(U), weight
        self.wanted = np.zeros(SLOTS, bool)
        self.wanted[index] = True

    def score(self, column) -> np.ndarray:
        held, first = slots(column, self.wanted)
        total = np.concatenate(([0.0], np.cumsum(self.weight[np.searchsorted(self.index, held)])))
        return 1 / (1 + np.exp(-np.clip(self.bias + total[first[1:]] - total[first[:-1]], -500, 500)))


def fit(rows: list[tuple[int, bytes, bytes]], strength: float = 100.0, l1: float = 0.3, l2: float = 0.1, rounds: int = 400) -> Classifier:
    """The classifier; strength weighs the counterfactual penalty."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Classifier(float(np.clip(np.log(max(rate, 1e-300) / max(1 - rate, 1e-300)), -500, 500)), np.zeros(0, int), np.zeros(0))
    rate = y.mean()
    bias = np.log(rate / (1 - rate))
    l1 *= np.sqrt(len(y) * rate * (1 - rate))
    sets = [np.frombuffer(r[1], "<u4") for r in rows]
    often, pulled = np.zeros(SLOTS, np.int64), np.zeros(SLOTS)
    for held, label in zip(sets, y, strict=True):
        often[held] += 1
        pulled[held] += label - rate
    # a word whose pull on the bias alone is under half the penalty would not be picked
    many = (often >= 3) & (np.abs(pulled) >= l1 / 2)
    column = np.flatnonzero(many)
    sets = [held[many[held]] for held in sets]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    slot = np.searchsorted(column, np.concatenate(sets))

    seen, times = np.unique(np.concatenate([np.frombuffer(r[2], "<u4") for r in rows]).astype(np.int64), return_counts=True)

    def descend(row, slot, size, bias, l1, l2, pull, rounds=rounds):
        """Accelerated proximal gradient on the sum of losses, a step size per word."""
        w, v, t = np.zeros(size), np.zeros(size), 1.0
        # the curvature of a text with k of these words is at most (k + 1) / 4
        length = np.bincount(row, minlength=len(y)) + 1.0
        step = 1 / (np.bincount(slot, length[row] / 4, size) + l2 + (0 if pull is None else 4 * strength * pull[2]))
        bias_step = 4 / length.sum()
        b = u = bias
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[slot], len(y)) + u, -500, 500)))
            g = np.bincount(slot, (p - y)[row], size) + l2 * v
            if pull is not None:
                change = v[pull[0]] * pull[1]
                change = change.sum(1)
                g += np.bincount(pull[0].ravel(), (2 * strength * change[:, None] * pull[1]).ravel(), size)
            x = v - step * g
            x = np.sign(x) * np.maximum(np.abs(x) - step * l1, 0)
            c = u - bias_step * (p - y).sum()
            nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, u = x + (t - 1) / nxt * (x - w), c + (t - 1) / nxt * (c - b)
            w, b, t = x, c, nxt
        return w, b

    w, bias = descend(row, slot, len(column), bias, l1, 0.0, swaps(column, seen, times))
    picked = np.abs(w) > 0
    if not picked.any():
        return Classifier(bias, np.zeros(0, int), np.zeros(0))
    keep = picked[slot]
    row, slot, column = row[keep], (np.cumsum(picked) - 1)[slot[keep]], column[picked]
    w, bias = descend(row, slot, len(column), bias, 0.0, l2, swaps(column, seen, times), 4 * rounds)
    return Classifier(bias, column, w)


def swaps(column: np.ndarray, seen: np.ndarray, times: np.ndarray):
    """Counterfactuals of sentences by their identity terms: (pairs of places in column, signs weighted, curvature by word).

    seen, times: slots of identity terms, and how many labelled sentences have each.  A term that isn't in column has
    weight 0, so swapping it in is the same as dropping the term.
    """
    place = {int(c): i for i, c in enumerate(column) if c in set(seen.tolist())}
    count = dict(zip(seen.tolist(), times.tolist(), strict=True))
    left, right, weight = [], [], []
    for terms in _KINDS.values():
        own = [int(t) for t in np.unique((terms % U(SLOTS)).astype(np.int64)) if int(t) in place]
        for a in own:
            for b in [*(b for b in own if b != a), -1]:
                left.append(place[a])
                right.append(place[b] if b >= 0 else place[a])
                weight.append((np.sqrt(count[a]), -np.sqrt(count[a]) if b >= 0 else 0.0))
    if not left:
        return None
    pairs, signs = np.stack((left, right), 1), np.array(weight)
    # of a square of a sum of two, at most twice the sum of both squares
    return pairs, signs, np.bincount(pairs.ravel(), (signs**2).ravel(), len(column))


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, folds: int = 5, held: int = 0, strength: float = 100.0) -> Classifier:
    X.tune(docs.sparkSession)
    return fit(sample(docs, labels, most, folds, held), strength)


def classify(docs: DataFrame, labels: DataFrame, most: int = 12_000, folds: int = 5, held: int = 0, strength: float = 100.0) -> DataFrame:
    """All columns of docs and toxicity_score: 0 to 1."""
    return with_score(docs, train(docs, labels, most, folds, held, strength), "toxicity_score")


def with_score(docs: DataFrame, model: Classifier, name: str) -> DataFrame:
    docs = docs.drop(name)
    holder = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(holder.value.score(piece.column(at)))], [*names, name])

    names = docs.columns
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
