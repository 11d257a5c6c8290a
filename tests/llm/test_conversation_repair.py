"""Conversation repair against a slow search for the cheapest edits, over short, long and odd conversations."""

import hashlib
import itertools
import random
import re
import zlib

from tessera.llm import conversation_repair as cr
from tessera.llm import registry
from tessera.llm.common import table

BLANK = " \t\n\x0b\f\r"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.strip(BLANK)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def slow_repair(rows):
    """(cost, audit, lines) by growing all ways turn by turn; kept for each end of the role initials so far."""
    faults = faults_of(rows)

    def fits(roles):
        return re.fullmatch(r"(s?(ua)*u?)?", roles)

    def with_inserts(ways):
        out = dict(ways)
        for (cost, audit), (roles, lines) in ways.items():
            for n in (1, 2):
                for new in itertools.product(("user", "assistant"), repeat=n):
                    if fits(more := roles + "".join(x[0] for x in new)):
                        out[cost + 5 * n, audit + "I" * n] = (more, [*lines, *[f"{x}:" for x in new]])
        return out

    def best(ways):
        kept = {}
        for key in sorted(ways):
            roles = ways[key][0]
            kept.setdefault((roles[-1:], len(roles) and roles == "s"), (key, ways[key]))
        return dict(kept.values())

    ways = {(0, ""): ("", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        out = {}
        for (cost, audit), (roles, lines) in with_inserts(ways).items():
            steps = [(2, "D", None)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                steps += [(more, "K", role), (1 + more, "R", "user"), (1 + more, "R", "assistant")]
            for price, letter, new in steps:
                if new is None or new[:1] in tuple("sua") and fits(roles + new[0]):
                    key = (cost + price, audit + letter)
                    value = (roles + new[0], [*lines, f"{new}:{text}"]) if new else (roles, lines)
                    # two ways of one audit have the same roles but for reroles that cannot fit both
                    out[key] = value
        ways = best(out)
    ends = {k: v for k, v in with_inserts(ways).items() if re.fullmatch(r"(s?(ua)+)?", v[0])}
    (cost, audit), (_, lines) = min(ends.items())
    return cost, audit, "\n".join(lines)


def slow_report(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults = faults_of(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, text = slow_repair(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def reports(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def check(spark, rows, **names):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    convs = {}
    for c, *rest in rows:
        convs.setdefault(c, []).append(rest)
    want = {c: slow_report(x) for c, x in convs.items()}
    got = reports(cr.repair_reports(df))
    assert got == want
    lines = {}
    for r in cr.repaired_turns(df).collect():
        lines.setdefault(r.conv_id, []).append((r.place, r.nth, f"{r.role}:{r.text}", r.edit))
    assert {c: hashlib.sha256("\n".join(x[2] for x in sorted(v)).encode()).hexdigest() for c, v in lines.items()} == {c: w[-1] for c, w in want.items() if c in lines}
    assert {c: "".join(x[3] for x in sorted(v)) for c, v in lines.items()} == {c: w[-2].replace("D", "") for c, w in want.items() if w[-2].strip("D")}


def made(seed, lengths):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", "What?", "cut off", "Go!  ", "\x0b", "é.", "\xa0", *(f"turn {k}." for k in range(40))]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    return [(c, rng.choice([k, k, k, k + 1, None]) if k % 9 == 4 else k, rng.choice(roles), rng.choice([*texts, None])) for c, n in lengths for k in range(n)]


def test_repair_of_many(spark):
    check(spark, made(1, [(c, c % 13) for c in range(160)]))


def test_repair_of_long_conversations(spark):
    """The third conversation holds most rows and spans partitions."""
    check(spark, made(2, [(1, 40), (2, 3), (3, 900), (None, 130), (5, 1), (6, 4)]))
    check(spark, made(3, [(7, 700)]))


def test_a_repeated_row_and_one_turn(spark):
    check(spark, [(1, 5, "user", "The same.")] * 120 + [(2, None, "assistant", f"a{k}.") for k in range(50)])


def test_repair_odd(spark):
    long = "w " * 200_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, None, None, None), (None, 0, "user", "Hi."), (None, 1, "assistant", "Ho.")]
    check(spark, rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS kind", "1 AS pos", "'k' AS digest", "2 AS conv", "3 AS tag")
    every = spark.createDataFrame([(1,), (9,), (9,), (None,)], "c bigint")
    got = reports(cr.repair_reports(df, every=every))
    assert set(got) == {1, 2, None, 9} and got[9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert reports(cr.repair_reports(df.limit(0))) == {} and cr.repaired_turns(df.limit(0)).count() == 0
    assert set(reports(cr.repair_reports(df.limit(0), every=every))) == {1, 9, None}
    named = df.selectExpr("concat('c', conv_id) AS c", "turn AS t", "role AS r", "text AS x")
    assert {k: v for k, v in reports(cr.repair_reports(named, "c", "t", "r", "x")).items() if k} == {f"c{k}": v for k, v in got.items() if k in (1, 2)}


def test_products_group_freely():
    rng = random.Random(4)
    for _ in range(60):
        kinds = bytes(rng.randrange(12) for _ in range(rng.randrange(1, 30)))
        one = cr.ONE
        for k in kinds:
            one = cr.times(one, cr.TURNS[k])
        cut = rng.randrange(len(kinds) + 1)
        assert cr.scan(kinds) == one == cr.times(cr.scan(kinds[:cut]), cr.scan(kinds[cut:]))


def test_repair_query(spark, sf_dir):
    convs = {}
    for r in table(spark, sf_dir, "conversations").collect():
        rows = convs.setdefault(r.conv_id, [])
        code = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", r.text) if code == 2 else r.text
        rows += [(r.turn, "user" if code == 4 else r.role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    assert reports(registry.QUERIES["op13_conversation_repair"](spark, sf_dir)) == {c: slow_report(x) for c, x in convs.items()}
