"""Substitution ciphers learned by expectation-maximization against letter bigrams.

A text whose bytes were read by a wrong page of single bytes is the original under a substitution of its letters. What
is known of a source's cipher is how often its signs follow each other; what is known of the language is how often
letters do. The probability of a pair of signs is the sum, over all pairs of letters, of the language's probability of
the pair times the probabilities that the letters are written by these signs. Expectation-maximization raises the
likelihood of the counted pairs: the expectation step shares every pair of signs out among the pairs of letters, the
maximization step sets the probability of each sign under each letter. Both are a few products of small matrices, so
the cost depends on the alphabet and not on the amount of text. A known page is a starting point and a weak prior;
without one each alphabet is tried from several random starts. Signs and letters are then paired one to one and pairs
exchanged while that makes the text likelier.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from shelfmark.llm.charlm import BigramModel

#: Blocks of alphabets that pages of single bytes hold, as (first, last) code points.
ALPHABETS = {
    "latin": (0xC0, 0x24F),
    "greek": (0x386, 0x3CE),
    "cyrillic": (0x400, 0x45F),
    "armenian": (0x531, 0x586),
    "hebrew": (0x5D0, 0x5EA),
    "arabic": (0x621, 0x64A),
    "thai": (0xE01, 0xE5B),
}


#: How many characters beyond ASCII a page of single bytes holds.
PAGE_SIGNS = 128


@dataclass(frozen=True)
class CipherOptions:
    """rounds: steps of expectation-maximization. starts: random starts for each alphabet where no page is known;
    climbed: how many of the likeliest are improved by exchanges. least_letter: how often a letter must occur in the language. prior: the weight, in counts, of the known page's
    reading. least_signs: how many signs a source needs before a cipher is learned without a page. symbol_cost: what
    naming the letter of one sign costs, in log probability; a cipher must gain more than it costs to state, and its
    text must have a mean log probability of `least_mean` a step, as text of a language does."""

    rounds: int = 40
    starts: int = 4
    climbed: int = 3
    least_letter: float = 3.0
    prior: float = 8.0
    least_signs: int = 200
    symbol_cost: float = 8.0
    least_mean: float = -3.5


@dataclass(frozen=True)
class Learned:
    """signs and letters, place by place; gain: by how much the source's text became likelier; mean: the mean log
    probability of a step in the restored text."""

    signs: str
    letters: str
    gain: float
    mean: float


def letters_of(model: BigramModel, alphabet: tuple[int, int], least: float) -> list[str]:
    """The letters of an alphabet that the language uses."""
    block = [chr(c) for c in range(alphabet[0], alphabet[1] + 1) if chr(c).isalpha()]
    return [c for c in block if model.count_of(c) >= least]


def _steps(model: BigramModel, hidden: list[str]) -> np.ndarray:
    """The joint log probability of each two letters that follow each other."""
    points = np.array([ord(c) for c in hidden], dtype=np.uint32)
    pairs = model.pair_counts(points) + 0.02
    return np.log(pairs / pairs.sum())


def _climb(joint: np.ndarray, counts: np.ndarray, chosen: np.ndarray, signs: int, letters: int) -> np.ndarray:
    """Move signs to other letters, and exchange two, while the text becomes likelier."""

    def value(of: np.ndarray) -> float:
        return float((counts * joint[np.ix_(of, of)]).sum())

    now, best = chosen.copy(), value(chosen)
    order = np.argsort(-counts[:signs].sum(1) - counts[:, :signs].sum(0), kind="stable")
    for _ in range(10):
        improved = False
        for i in order:
            moved = joint[:, now] @ counts[i] + joint[now].T @ counts[:, i]
            for h in np.argsort(-moved[:letters], kind="stable")[:8]:
                if h == now[i]:
                    continue
                tried = now.copy()
                holder = np.flatnonzero(now[:signs] == h)
                tried[i] = h
                if len(holder):
                    tried[holder[0]] = now[i]
                if (got := value(tried)) > best + 1e-6:
                    now, best, improved = tried, got, True
        if not improved:
            break
    return now


def _one_to_one(posterior: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Give each sign the likeliest letter that no heavier claim has taken; signs beyond the letters share."""
    claims = posterior * weight[:, None]
    order = np.dstack(np.unravel_index(np.argsort(-claims, axis=None, kind="stable"), claims.shape))[0]
    out, taken = np.full(len(claims), -1), set()
    for s, h in order:
        if out[s] < 0 and h not in taken:
            out[s] = h
            taken.add(int(h))
    rest = np.flatnonzero(out < 0)
    out[rest] = posterior[rest].argmax(1)
    return out


def likelihood(pairs: dict[tuple[str, str], float], table: dict[str, str], model: BigramModel) -> float:
    """The log probability of counted pairs once their signs are read by a table."""
    points = np.array([[ord(table.get(c, c)) for c in pair] for pair in pairs], dtype=np.uint32)
    steps = model.log_pairs(model.classes[np.minimum(points, 0x2FFFF)].reshape(-1))[::2]
    return float((steps * np.fromiter(pairs.values(), dtype=np.float64)).sum())


def learn(
    pairs: dict[tuple[str, str], float],
    model: BigramModel,
    start: dict[str, str] | None = None,
    options: CipherOptions = CipherOptions(),
    known_pages: list[dict[str, str]] | tuple = (),
) -> Learned | None:
    """The cipher of a source, from how often its characters follow each other; ASCII characters stand for themselves.

    start: the reading of each sign by a known page; the learned reading differs where the text speaks against it.
    known_pages: readings to begin with where the page is not known, besides random ones; the likeliest is tried.
    Without a start None is returned if the source has too little text, or no alphabet makes it likelier by more than the
    cipher costs to state. The same counts always give the same cipher.
    """
    met: dict[str, float] = {}
    for pair, n in pairs.items():
        for c in pair:
            if ord(c) > 0x7F:
                met[c] = met.get(c, 0.0) + n
    # a page of single bytes has no more signs beyond ASCII: what is rarer than so many others is not of the page
    signs = sorted(sorted(met, key=lambda c: (-met[c], c))[:PAGE_SIGNS])
    if len(met) > len(signs):
        held = set(signs)
        pairs = {p: n for p, n in pairs.items() if all(c in held or ord(c) <= 0x7F for c in p)}
    known = sorted({c for pair in pairs for c in pair if ord(c) <= 0x7F})
    total = sum(n for (a, b), n in pairs.items() if ord(b) > 0x7F)
    if not signs or (start is None and total < options.least_signs):
        return None
    place = {c: i for i, c in enumerate(signs + known)}
    counts = np.zeros((len(place), len(place)))
    for (a, b), n in pairs.items():
        counts[place[a], place[b]] += n
    weight = counts[: len(signs)].sum(1) + counts[:, : len(signs)].sum(0)
    if start is not None:
        attempts = [(start, None)]
    else:
        blocks = [letters_of(model, block, options.least_letter) for block in ALPHABETS.values()]
        attempts = [(None, b) for b in blocks if len(b) >= max(2, len(signs) / 3)]
        likely_pages = sorted(known_pages, key=lambda page: -likelihood(pairs, page, model))[:1]
        attempts += [({s: page.get(s, s) for s in signs}, None) for page in likely_pages]
    found: list[tuple[float, np.ndarray, list[str], np.ndarray, dict[str, str] | None]] = []
    for page, letters in attempts:
        letters = letters or sorted({page.get(s, s) for s in signs})
        hidden = letters + known
        joint = _steps(model, hidden)
        prob = np.exp(joint)
        prior = np.full((len(signs), len(letters)), 1e-6)
        if page is not None:
            at = {h: i for i, h in enumerate(letters)}
            for i, s in enumerate(signs):
                prior[i, at[page.get(s, s)]] += options.prior
        for seed in range(1 if page is not None else options.starts):
            write = np.zeros((len(place), len(hidden)))
            write[len(signs) :, len(letters) :] = np.eye(len(known))
            first = prior + 1e-3 if page is not None else np.random.default_rng(seed).gamma(20.0, size=prior.shape)
            write[: len(signs), : len(letters)] = first / first.sum(0)
            for _ in range(options.rounds):
                share = counts / (write @ prob @ write.T + 1e-300)
                expected = write * (share @ write @ prob.T + share.T @ write @ prob)
                block = expected[: len(signs), : len(letters)] + prior
                write[: len(signs), : len(letters)] = block / block.sum(0)
            likely = float((counts * np.log(write @ prob @ write.T + 1e-300)).sum())
            belief = write[: len(signs), : len(letters)] * prob.sum(1)[: len(letters)]
            found.append((likely, belief / belief.sum(1, keepdims=True), letters, joint, page))
    blind = sorted((f for f in found if f[4] is None), key=lambda f: -f[0])[: options.climbed]
    best: tuple[float, float, dict[str, str]] | None = None
    for _, belief, letters, joint, page in blind + [f for f in found if f[4] is not None]:
        fixed = np.arange(len(letters), len(joint))
        if page is not None:
            chosen = belief.argmax(1)
        else:
            chosen = _climb(joint, counts, np.concatenate([_one_to_one(belief, weight), fixed]), len(signs), len(letters))
        table = {s: letters[h] for s, h in zip(signs, chosen)}
        # what a public page says of a sign need not be stated
        cost = options.symbol_cost * sum(page is None or page.get(s) != h for s, h in table.items())
        likely = likelihood(pairs, table, model)
        if best is None or likely - cost > best[0]:
            best = (likely - cost, likely, table)
    if best is None:
        return None
    worth, after, table = best
    before = likelihood(pairs, {}, model)
    gain, mean = after - before, after / sum(pairs.values())
    if start is None and (worth <= before + options.symbol_cost * len(signs) / 2 or mean < options.least_mean):
        return None
    return Learned("".join(table), "".join(table.values()), gain, mean)
