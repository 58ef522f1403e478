import itertools
import random

import pytest

from readloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, place int, cost int, first int"
ROLES = ["system", "user", "assistant", "User ", "gpt", "tool", None]


def rows(seed, convs, most):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            out.append((c, t if rng.random() > 0.1 else None, rng.choice(ROLES), rng.choice(["", None, "hello", "text 🙂", f"t{t}"])))
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in data], SCHEMA)


def legal(sequence):
    body = sequence[1:] if sequence[:1] == ["system"] else sequence
    return len(body) >= 2 and len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))


def brute_cost(roles):
    """Cheapest repair by trying every relabelling, every merge and every insertion of up to two turns in a gap."""
    codes = [chat.role_code(r) for r in roles]
    best = None
    for new in itertools.product(range(3), repeat=len(codes)):
        change = sum(0 if a == b else chat.UNKNOWN if a == 3 else chat.RELABEL for a, b in zip(codes, new))
        for merges in itertools.product((0, 1), repeat=len(codes)):
            if merges[0] or any(m and new[i] != new[i - 1] for i, m in enumerate(merges)):
                continue
            kept = [chat.ROLES[n] for n, m in zip(new, merges) if not m]
            gaps = len(kept) + 1
            fills = [(), ("user",), ("assistant",), ("user", "assistant")]
            for fill in itertools.product(fills, repeat=gaps):
                seq = list(fill[0])
                for k, f in zip(kept, fill[1:]):
                    seq += [k, *f]
                if legal(seq):
                    cost = change + chat.MERGE * sum(merges) + chat.INSERT * sum(map(len, fill))
                    best = cost if best is None else min(best, cost)
    return best


def test_cheapest():
    rng = random.Random(0)
    for _ in range(150):
        roles = [rng.choice(ROLES) for _ in range(rng.randint(1, 4))]
        costs, _ = chat.forward([(chat.role_code(r), (0, 0, 0)) for r in roles], chat.one_hot(chat.START))
        end = chat.closed(costs)
        assert (costs[end] >> chat.SHIFT) + chat.INSERT * len(chat.CLOSING[end]) == brute_cost(roles), roles


def parse(text):
    return [x.split("\n", 1) for x in text.replace("<|im_end|>\n", "").split("<|im_start|>")[1:]]


def check(got, data):
    by_conv = {}
    for r in got:
        by_conv.setdefault(r.conv_id, []).append(r)
    assert len(got) == len(data)
    for conv, group in by_conv.items():
        group.sort(key=lambda r: r.position)
        assert [r.position for r in group] == list(range(len(group)))
        mine = sorted([r for r in data if r[0] == conv], key=lambda r: tuple((x is not None, x or "" if not isinstance(x, int) else x) for x in r[1:]))
        assert [(r.turn, r.role) for r in group] == [(r[1], r[2]) for r in mine]
        text = "".join(r.fragment for r in group)
        assert legal([x[0] for x in parse(text)]) and text.endswith("<|im_end|>\n")
        turns = [(chat.role_code(r[2]), chat.weights(*r[1:])) for r in mine]
        costs, _ = chat.forward(turns, chat.one_hot(chat.START))
        end = chat.closed(costs)
        assert sum(r.cost for r in group) == (costs[end] >> chat.SHIFT) + chat.INSERT * len(chat.CLOSING[end])
        for r in mine:
            assert (r[3] or "") in text


@pytest.mark.parametrize("convs, most", [(40, 8), (2, 300), (1, 500)])
def test_repair(spark, convs, most):
    data = rows(convs, convs, most)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data would come in one part
    got = chat.repair(frame(spark, data)).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(got, data)


@pytest.mark.parametrize("same", [False, True])
def test_order_hangs_on_rows_alone(spark, same):
    """The rendered conversation is the same for any number of partitions, with ties in turn and role, too."""
    rng = random.Random(7)
    data = [(1, 0 if same else rng.randrange(3), "user" if same else rng.choice(ROLES), f"text {rng.randrange(900)}") for _ in range(1500)]
    found = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted((r.position, r.turn or 0, r.role or "", r.new_role, r.action, r.cost, r.fragment) for r in chat.repair(frame(spark, rng.sample(data, len(data)))).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] == found[2] and len(found[0]) == 1500


def test_odd_rows(spark):
    data = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (2, None, None, None), (3, 5, "system", "only"), (4, 1, "user", "long " * 100000)]
    got = chat.repair(frame(spark, data)).collect()
    check([r for r in got if r.conv_id is not None], [r for r in data if r[0] is not None])
    alone = [r for r in got if r.conv_id is None]
    assert len(alone) == 2 and all(legal([x[0] for x in parse(r.fragment)]) for r in alone)


def test_empty(spark):
    assert chat.repair(frame(spark, [])).count() == 0


def shortest(roles):
    """The cheapest repair as a shortest path over (turns done, role of the last turn), a step a turn or an inserted empty one."""
    import heapq

    codes, follows = [chat.role_code(r) for r in roles], {None: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
    heap, done = [(0, 0, -1)], set()
    while heap:
        cost, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(codes) and last == 2:
            return cost
        now = None if last < 0 else last
        for role in follows[now]:
            heapq.heappush(heap, (cost + chat.INSERT, i, role))
        if i < len(codes):
            for role in range(3):
                change = 0 if codes[i] == role else chat.UNKNOWN if codes[i] == 3 else chat.RELABEL
                if role in follows[now]:
                    heapq.heappush(heap, (cost + change, i + 1, role))
                if role == now:
                    heapq.heappush(heap, (cost + change + chat.MERGE, i + 1, role))
    return None


def test_costs_and_rendering_of_long_conversations(spark):
    """Cost against the shortest path, and the joined fragments against a rendering of the actions, for conversations of up to 14 turns."""
    data = [(c, t, r, x) for c, t, r, x in rows(11, 60, 14) if t is not None]
    got = chat.repair(frame(spark, data).repartition(3)).collect()
    texts = {}
    for c, t, _, x in data:
        texts.setdefault(c, {})[t] = x or ""
    for c in texts:
        group = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        said = []
        for r in group:
            said += [[x, ""] for x in r.inserted_before.split(",") if x]
            if r.action.endswith("merge"):
                said[-1][1] += "\n" + texts[c][r.turn]
            else:
                said.append([r.new_role, texts[c][r.turn]])
            said += [[x, ""] for x in r.inserted_after.split(",") if x]
        assert legal([x[0] for x in said])
        assert "".join(r.fragment for r in group) == "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in said)
        assert sum(r.cost for r in group) == shortest([r.role for r in group])
