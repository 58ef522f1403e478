"""Seating customers in Pitman-Yor restaurants, many dishes at once, and the gamma functions that it takes."""

from __future__ import annotations

import numpy as np

#: Customers that are seated one by one in one batch of arrays.
BATCH = 1 << 20


def uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes and a salt."""
    z = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series from x + 4 on; errors are below 1e-9 of 1 + |it|."""
    x = np.asarray(x, np.float64)
    y = x + 4
    r = 1 / y
    z = r * r
    series = r * (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360)))))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(x * (x + 1) * (x + 2) * (x + 3))


def expected_tables(customers: np.ndarray, strength: np.ndarray, discount: float) -> np.ndarray:
    """Mean number of tables of a restaurant with so many customers; strength > -discount."""
    ratio = lgamma(strength + 1) + lgamma(strength + discount + customers) - lgamma(strength + discount) - lgamma(strength + customers)
    return (np.exp(ratio) - strength) / discount


def _one_by_one(customers: np.ndarray, strength: np.ndarray, discount: float, h: np.ndarray, salt: int) -> np.ndarray:
    """Tables when every customer is seated by a number of its own. Who opens a table hangs on the tables before, so the rows of
    customers are gone through until nothing changes: the first i are right after i rounds, all of them after a few."""
    out = np.ones(len(customers))
    more = (customers - 1).astype(np.int64)
    batch = (np.cumsum(more) - more) // BATCH
    for dishes in np.split(np.arange(len(more)), np.flatnonzero(np.diff(batch)) + 1) if len(more) else ():
        n = more[dishes]
        first = np.cumsum(n) - n
        which = np.repeat(np.arange(len(dishes)), n)
        seated = np.arange(len(which)) - first[which] + 1.0
        u = uniform(h[dishes][which] + seated.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), salt)
        u *= strength[dishes][which] + seated
        u -= strength[dishes][which]
        u /= discount  # a customer opens a table if so many are open already
        opens = u < 1
        while True:
            total = np.cumsum(opens)
            before = total - opens - (total - opens)[first][which] + 1
            new = u < before
            if (new == opens).all():
                break
            opens = new
        out[dishes] += np.add.reduceat(opens, first)
    return out


def _by_leaps(customers: np.ndarray, strength: np.ndarray, discount: float, h: np.ndarray, salt: int) -> np.ndarray:
    """As _one_by_one, but each step goes to the next customer who opens a table: the number of those who do not has a
    survival function in closed form."""
    tables = np.ones(len(customers))
    live = np.flatnonzero(customers > 1)
    seated, step = np.ones(len(live)), 0
    while len(live):
        step += 1
        c, s, b = customers[live], strength[live], discount * tables[live]
        start = lgamma(seated - b) - lgamma(seated + s)
        drawn = np.log(uniform(h[live], salt * 1048583 + step))
        go = lgamma(c - b) - lgamma(c + s) - start < drawn  # someone opens one before the customers end
        live, seated, c, s, b, start, drawn = (x[go] for x in (live, seated, c, s, b, start, drawn))
        first, last = seated.copy(), c - 1
        now = np.log((seated - b) / (seated + s)) < drawn
        last[now] = first[now]
        while (wide := np.flatnonzero(first < last)).size:
            mid = np.floor((first[wide] + last[wide]) / 2)
            below = lgamma(mid + 1 - b[wide]) - lgamma(mid + 1 + s[wide]) - start[wide] < drawn[wide]
            last[wide[below]] = mid[below]
            first[wide[~below]] = mid[~below] + 1
        tables[live] += 1
        seated = first + 1
        go = seated < c
        live, seated = live[go], seated[go]
    return tables


def _proposal(customers: np.ndarray, base: np.ndarray, power: np.ndarray, discount: float) -> np.ndarray:
    """The strength of a restaurant of the dish alone whose mean number of tables m is about the likeliest one: strength +
    discount m = base (power + discount m). Solved by halving; any solution is a sound proposal."""
    out = np.maximum(base * (power + discount) - discount, 2e-6 - discount)  # by the odds of the second table alone
    if not len(many := np.flatnonzero(customers > 16)):
        return out
    n, p, power = customers[many], base[many], power[many]
    low, high = np.full(len(many), 1e-6 - discount), out[many].copy()
    for _ in range(10):
        mid = (low + high) / 2
        m = expected_tables(n, mid, discount)
        over = mid + discount * m > p * (power + discount * m)
        high, low = np.where(over, mid, high), np.where(over, low, mid)
    out[many] = (low + high) / 2
    return out


def seat(tables: np.ndarray, customers: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, h: np.ndarray, salt: int) -> np.ndarray:
    """One step of the sampler for each dish: its customers leave and are seated anew, given the tables of all other dishes.

    tables (0: not seated yet), customers: as they are, base: the parent's probability of the dish, others: tables of the restaurant's other dishes,
    h: a hash of each dish, which fixes the draw. Given the others, t tables have a probability in proportion to the number of
    seatings (a generalised Stirling number) times the product over i < t of base (strength + discount (others + i)). A new
    seating is drawn customer by customer from a restaurant of the dish alone, whose probability holds the same number of
    seatings; so the two differ by a factor of t, and the new seating is taken by the rule of Metropolis and Hastings. This
    is the same for any number of customers; only the way of drawing it is chosen by what it costs."""
    customers, tables = np.asarray(customers, np.float64), np.minimum(np.asarray(tables, np.float64), customers)
    some = np.flatnonzero(customers > 1)
    out = np.minimum(customers, 1)
    if not len(some):
        return out
    c, p, power, dish = customers[some], base[some], strength + discount * others[some], h[some]
    alone = _proposal(c, p, power, discount)
    leap = expected_tables(c, alone, discount) * 256 < c
    leap |= c <= 4
    new = np.empty(len(some))
    new[leap] = _by_leaps(c[leap], alone[leap], discount, dish[leap], salt)
    new[~leap] = _one_by_one(c[~leap], alone[~leap], discount, dish[~leap], salt)
    factor = lambda t: (t - 1) * np.log(p) + lgamma(power / discount + t) - lgamma(alone / discount + t)
    taken = np.log(uniform(dish, salt * 64 + 63)) < factor(new) - factor(np.maximum(tables[some], 1))
    out[some] = np.where(taken | (tables[some] < 1), new, tables[some])
    return out


def log_strengths(grid: np.ndarray, discount: float, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Log likelihood of each strength of the grid, summed over restaurants of so many customers and tables."""
    out = np.zeros(len(grid))
    some = customers > 0
    c, t = customers[some].astype(np.float64), tables[some].astype(np.float64)
    for i, s in enumerate(grid):
        out[i] = np.sum(lgamma(s / discount + t) - lgamma(np.array([s / discount + 1])) - lgamma(s + c) + lgamma(np.array([s + 1])))
    return out


def drawn_strength(grid: np.ndarray, log_likelihood: np.ndarray, salt: int) -> float:
    """A strength of the grid in proportion to its likelihood; grids have equal steps of the logarithm, which is the prior."""
    p = np.exp(log_likelihood - log_likelihood.max())
    u = uniform(np.array([0x5EA7], np.uint64), salt)[0]
    return float(grid[min(len(grid) - 1, int(np.searchsorted(np.cumsum(p) / p.sum(), u)))])
