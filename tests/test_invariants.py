"""Operators whose result is greedy, seeded or iterative, against plain loops or by what must hold of any result."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import context as C
from tessera.operators import graph as G
from tessera.operators import leiden as L
from tessera.operators import order as O
from tessera.operators import projection as P
from tessera.operators import search as S
from tessera.operators import update as U
from tessera.operators.packing import pack_whole
from tessera.plans import context_queries, inputs, registry, search_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rel(spark):
    return inputs.relationships(spark, SF).collect()


def connected(nodes, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a in nodes and b in nodes:
            near[a].add(b), near[b].add(a)
    seen, todo = set(), [next(iter(nodes))]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += near[n] - seen
    return seen == set(nodes)


def test_clusters(spark):
    """Three dense groups, one of them of groups: each level parts its parents, clusters hold together, none stays too large."""
    rnd, pairs = random.Random(3), set()
    for g in range(6):
        own = [f"n{g}-{i:02d}" for i in range(9)]
        pairs |= {(a, b) for i, a in enumerate(own) for b in own[:i] if rnd.random() < 0.8}
        if g % 2:
            pairs |= {(f"n{g}-{i:02d}", f"n{g - 1}-{i:02d}") for i in range(4)}
    edges = spark.createDataFrame([(*sorted(p), 1.0) for p in pairs], "a string, b string, weight double")
    rows = G.hierarchical_clusters(edges, max_size=10).collect()
    groups, parent = defaultdict(set), {}
    for r in rows:
        groups[r.level, r.community].add(r.title)
        parent[r.level, r.community] = r.parent
    assert set().union(*(m for (lv, _), m in groups.items() if lv == 0)) == {n for p in pairs for n in p}
    for (level, name), members in groups.items():
        assert name == min(members) and connected(members, pairs)
        kids = [m for (lv, k), m in groups.items() if lv == level + 1 and parent[lv, k] == name]
        if kids:
            assert len(members) > 10 and len(kids) > 1 and sum(map(len, kids)) == len(members) and set().union(*kids) == members
        else:
            assert len(members) <= 10


def test_clique_cannot_be_parted(spark):
    edges = spark.createDataFrame([(f"k{j:02d}", f"k{i:02d}", 1.0) for i in range(14) for j in range(i)], "a string, b string, weight double")
    rows = G.hierarchical_clusters(edges, max_size=10).collect()
    assert {(r.level, r.community, r.parent) for r in rows} == {(0, "k00", None)} and len(rows) == 14


def louvain(edges):
    """Plain single-machine Louvain, as a mark that modularity must reach."""
    near = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        near[a][b] += w
        if a != b:
            near[b][a] += w
    total = sum(w for _, _, w in edges)
    name = {n: n for n in near}
    while True:
        k = {n: sum(near[n].values()) + near[n].get(n, 0.0) for n in near}
        c, mass, any_move = {n: n for n in near}, dict(k), False
        moved = True
        while moved:
            moved = False
            for n in sorted(near):
                to = defaultdict(float)
                for o, w in near[n].items():
                    if o != n:
                        to[c[o]] += w
                mass[c[n]] -= k[n]
                gain = {d: w - k[n] * mass[d] / (2 * total) for d, w in to.items()}
                gain[c[n]] = to.get(c[n], 0.0) - k[n] * mass[c[n]] / (2 * total)
                best = max(sorted(gain), key=lambda d: (gain[d] > gain[c[n]] + 1e-12, gain[d]))
                if gain[best] > gain[c[n]] + 1e-12:
                    c[n], moved, any_move = best, True, True
                mass[c[n]] += k[n]
        if not any_move:
            return name
        name = {n: c[x] for n, x in name.items()}
        smaller = defaultdict(lambda: defaultdict(float))
        for a in near:
            for b, w in near[a].items():
                if a <= b:
                    smaller[c[a]][c[b]] += w
                    if c[a] != c[b]:
                        smaller[c[b]][c[a]] += w
        near = smaller


def modularity(edges, c):
    total, mass, inside = sum(w for _, _, w in edges), defaultdict(float), 0.0
    for a, b, w in edges:
        mass[c[a]] += w
        mass[c[b]] += w
        inside += w if c[a] == c[b] else 0.0
    return inside / total - sum(x * x for x in mass.values()) / (4 * total * total), mass


def held_communities(edges, c):
    """Every community is connected and no merge of two betters the modularity."""
    q, mass = modularity(edges, c)
    total, between, members = sum(w for _, _, w in edges), defaultdict(float), defaultdict(set)
    for n, x in c.items():
        members[x].add(n)
    for a, b, w in edges:
        if c[a] != c[b]:
            between[min(c[a], c[b]), max(c[a], c[b])] += w
    assert all(connected(m, [(a, b) for a, b, _ in edges]) for m in members.values())
    assert all(w - mass[x] * mass[y] / (2 * total) < 1e-6 for (x, y), w in between.items())
    return q


def test_communities_of_a_path(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(60)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    made = L.communities_of(df)
    c = {r.node: r.c for r in made.collect()}
    q = held_communities(edges, c)
    assert len(c) == 61 and 6 <= len(set(c.values())) <= 10 and q > 0.74
    assert abs(L.modularity(df, spark.createDataFrame(list(c.items()), "node string, c string")) - q) < 1e-9


def test_communities_reach_louvain(spark):
    rel = G.cluster_edges(inputs.relationships(spark, "/root/testdata/sf0.01").select("source", "target", "weight", "pos"))
    edges = [(r.a, r.b, float(r.weight)) for r in rel.collect()]
    c = {r.node: r.c for r in L.communities_of(rel).collect()}
    assert held_communities(edges, c) >= modularity(edges, louvain(edges))[0] - 1e-9


def test_graphs_side_by_side(spark):
    """A graph parted beside a much heavier one comes out as it does alone."""
    pairs = lambda p: [(f"{p}{i}{j}", f"{p}{i}{k}", 1.0) for i in range(2) for j in range(5) for k in range(j)] + [(f"{p}00", f"{p}10", 1.0)]
    rows = [(*e, "x") for e in pairs("x")] + [(a, b, 500.0, "y") for a, b, _ in pairs("y")]
    c = {r.node: r.c for r in L.communities_of(spark.createDataFrame(rows, "a string, b string, weight double, g string")).collect()}
    assert set(c.values()) == {"x00", "x10", "y00", "y10"}


def test_global_batches(spark):
    rows = registry.queries()["q27_global_batches"](spark, SF).collect()
    place = O.seeded_shuffle(sorted(r.id for r in rows))
    batch, run = 0, 0
    for r in sorted(rows, key=lambda r: place[r.id]):
        if run and run + r.cost > 60:
            batch, run = batch + 1, 0
        run += r.cost
        assert r.batch == batch
    e = S.memberships(inputs.entities(spark, SF), inputs.communities(spark, SF), 1)
    weight = {r.id: (r.occurrence, r["rank"]) for r in S.community_weights(inputs.reports(spark, SF), e).collect()}
    for k in {r.batch for r in rows}:
        own = sorted((r for r in rows if r.batch == k), key=lambda r: (-weight[r.id][0], -weight[r.id][1], place[r.id]))
        assert [r["at"] for r in own] == list(range(len(own)))


def test_community_weights_list_nothing(spark, tmp_path):
    """Units and entities meet as rows: no list of either is made, a name that repeats meets itself once a community, and orders count once."""
    customers = [(i, f"C{i % 7}", (i % 5) if i % 7 else 1) for i in range(60)] + [(60, "C60", 77), (61, None, 2)]
    suppliers = [(i, f"S{i}", i % 3) for i in range(6)]
    orders = [(o, o % 64) for o in range(300)]
    lines = [(o % 310, (o * 7) % 8) for o in range(900)]
    nations = [(n, f"N{n}", n % 2) for n in range(5)]
    for name, rows, schema in (("customer", customers, "c_custkey long, c_name string, c_nationkey int"), ("supplier", suppliers, "s_suppkey long, s_name string, s_nationkey int"), ("orders", orders, "o_orderkey long, o_custkey long"), ("lineitem", lines, "l_orderkey long, l_suppkey long"), ("nation", nations, "n_nationkey int, n_name string, n_regionkey int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    named, people = {}, [(("c", i), t, n) for i, t, n in customers] + [(("s", i), t, n) for i, t, n in suppliers]
    for _, t, n in people:
        if t is not None and n < 5:
            for c in (n % 2, n + 100):
                named.setdefault(c, set()).add(t)
    inside = {c: {k for k, t, _ in people if t in ts} for c, ts in named.items()}
    units = {c: {o for o, k in orders if ("c", k) in ks} | {o for o, k in lines if ("s", k) in ks} for c, ks in inside.items()}
    most = max(map(len, units.values()))
    want = {f"r{c}": round(len(units[c]) / most, 6) for c in named if (c * 7) % 10 >= 1}
    plan = inputs.community_units(spark, str(tmp_path)).union(inputs.reports(spark, str(tmp_path)).select("community", F.length("content")))
    assert "collect_" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.occurrence for r in registry.queries()["q26_community_weights"](spark, str(tmp_path)).collect()} == want
    assert {r.community: int(r.content[9:]) for r in inputs.reports(spark, str(tmp_path)).collect()} == {c: len(k) for c, k in inside.items()}
    assert {r.community: set(r.entity_ids) for r in inputs.communities(spark, str(tmp_path)).collect()} == {c: {f"{a}{b}" for a, b in k} for c, k in inside.items()}


@pytest.mark.parametrize("most,most_rows,parts", [(60, None, 8), (60, 3, 8), (5, None, 3), (100_000, None, 8), (400, 50, 8), (10**9, 7, 5)])
def test_packing_of_a_whole_table(spark, most, most_rows, parts):
    rnd = random.Random(most)
    costs = [rnd.choice([0, 1, 3, 9, 40, 90]) for _ in range(3_000)]
    df = spark.createDataFrame([(7 * i, c) for i, c in enumerate(costs)], "o long, c int").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.o // 7: r.batch for r in pack_whole(df, "c", most, "o", most_rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    batch, run, n = 0, 0, 0
    for i, c in enumerate(costs):
        if n and (run + c > most or most_rows and n >= most_rows):
            batch, run, n = batch + 1, 0, 0
        run, n = run + c, n + 1
        assert got[i] == batch
    assert len(got) == 3_000 and pack_whole(df.limit(0), "c", most, "o").count() == 0


def test_packing_by_rows_and_cost(spark):
    df = spark.createDataFrame([(i, c, "g") for i, c in enumerate([5, 5, 5, 90, 1, 1, 1, 1])], "at int, c int, g string")
    made = {r["at"]: r.batch for r in O.pack_in_order(df, "c", 12, "at", ["g"], most_rows=3).collect()}
    assert [made[i] for i in range(8)] == [0, 0, 1, 2, 3, 3, 3, 4]


def attempt(rel, chosen, top_k, learned):
    """Relationships of a context over ``chosen``, in order, with their links: the rule as a loop over one attempt after the other."""
    names = {e.title for e in chosen}
    near = [r for r in rel if r.source in names or r.target in names]
    inner = sorted(([r, learned.get(r.id)] for r in near if r.source in names and r.target in names), key=lambda x: (-x[0]["rank"], x[0].id))
    outer = sorted(([r, None] for r in near if not (r.source in names and r.target in names)), key=lambda x: (-x[0]["rank"], x[0].id))
    if len(outer) > 1:
        ends = [(r.target, r.source) if r.source in names else (r.source, r.target) for r, _ in outer]
        neighbours = defaultdict(set)
        for out, own in ends:
            neighbours[out].add(own)
        for x, (out, _) in zip(outer, ends):
            x[1] = learned[x[0].id] = len(neighbours[out])
        outer = sorted(outer, key=lambda x: (-x[1], -x[0]["rank"], x[0].id))[: top_k * len(chosen)]
    return inner + outer


def lines_of(shown):
    linked = bool(shown) and shown[0][1] is not None
    made = [f"{r.id}|{r.source}|{r.target}|{r.weight}" + (f"|{'' if n is None else n}" if linked else "") for r, n in shown]
    return made, "-----Relationships-----\nid|source|target|weight" + ("|links" if linked else "") + "\n"


def grown(rel, claims, chosen, spent, budget, top_k):
    """(relationships, claims by type) of the last attempt within ``budget``; the entity that brings too much goes back."""
    learned, accepted = {}, ([], {})
    for n in range(1, len(chosen) + 1):
        shown = attempt(rel, chosen[:n], top_k, learned)
        lines, head = lines_of(shown)
        cost = spent + (len(head) + sum(len(x) + 1 for x in lines) if lines else 0)
        groups = defaultdict(list)
        for e in chosen[:n]:
            for c in sorted((c for c in claims if c.subject_id == e.title), key=lambda c: (c.human_readable_id, c.id)):
                groups[c.covariate_type].append(f"{c.short_id}|{c.subject_id}|{c.covariate_type}|{c.description}")
        cost += sum(len(f"-----{k}-----\nid|entity|type|description\n") + sum(len(x) + 1 for x in g) for k, g in groups.items())
        if cost > budget:
            break
        accepted = (shown, groups)
    return accepted


@pytest.mark.parametrize("budget", [10, 90, 700, 1_500, 4_000, 100_000])
def test_local_context(spark, rel, budget):
    chosen = sorted(search_queries.selected(spark, SF).collect(), key=lambda e: e.place)
    want, learned = [], {}
    for n in range(1, len(chosen) + 1):
        shown = attempt(rel, chosen[:n], 10, learned)
        lines, _ = lines_of(shown)
        if sum(len(x) + 1 for x in lines) + len("-----Relationships-----\nid|source|target|weight\n") > budget:
            break
        want = [(r.id, -1 if n is None else n, len(x)) for (r, n), x in zip(shown, lines)]
    rows = search_queries.local_context(spark, SF, budget).collect()
    assert sorted((r.id, r.links, r.cost) for r in rows) == sorted(want)
    assert sum(r.cost + 1 for r in rows) <= budget


def test_expansion_of_touching_entities(spark):
    """Edges among the selected, repeated ones, loops, and outer ends that share neighbours."""
    rnd = random.Random(4)
    rows = [(f"r{i:03d}", f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}", rnd.randrange(4), float(i)) for i in range(70)]
    edges = spark.createDataFrame(rows, "id string, source string, target string, rank long, weight double")
    chosen = spark.createDataFrame([(f"n{i}", i) for i in range(6)], "title string, place int")
    rel, entities = edges.collect(), sorted(chosen.collect(), key=lambda e: e.place)
    for top_k in (1, 3):
        got, learned = defaultdict(list), {}
        for r in sorted(S.expansion(chosen, edges, top_k).collect(), key=lambda r: (r.prefix, r.part, r["at"])):
            got[r.prefix].append((r.id, r.links))
        for n in range(1, 7):
            assert got[n] == [(r.id, k) for r, k in attempt(rel, entities[:n], top_k, learned)]


def test_local_growth(spark, rel):
    """Relationships and claims of the composed search have one budget with the entities, headers counted."""
    chosen = sorted(search_queries.selected(spark, SF).collect(), key=lambda e: e.place)
    rows = context_queries.sections(spark, SF).collect()
    claims = context_queries.section_claims(spark, SF).collect()
    spent = sum(len(r.line) + 1 for r in rows if r.section == "Entities") + len("-----Entities-----\nid|entity|description\n")
    budget = int(6_000 * (1 - 0.5 - 0.15))
    shown, groups = grown(rel, claims, chosen, spent, budget, 10)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["at"]):
        by[r.section].append(r.line)
    assert by["Relationships"] == lines_of(shown)[0] and shown
    assert {k: by[k] for k in set(by) - {"Reports", "Entities", "Sources", "Relationships"}} == dict(groups)
    inside = [r for r in rows if r.in_context]
    assert sum(len(r.line) + 1 for r in inside) <= budget


@pytest.mark.parametrize("nodes,edges,page", [(60, 100, 20_000), (12, 40, 7), (5, 500, 3), (1, 4, 2)])
def test_overview(spark, rel, nodes, edges, page):
    loops = [("self", "Customer#000000001", "Customer#000000001", 0, None)]
    df = inputs.relationships(spark, SF).select("id", "source", "target", "rank", "weight").unionByName(spark.createDataFrame(loops, "id string, source string, target string, rank long, weight double"))
    rows = sorted(df.collect(), key=lambda r: (-r["rank"], -(r.weight if r.weight is not None else float("-inf")), r.id))
    held, want = set(), []
    for r in rows:
        new = {r.source, r.target} - held
        if len(want) < edges and len(held) + len(new) <= nodes:
            held |= new
            want.append((r.id, r.source, r.target))
    assert P.overview(df, nodes, edges, page) == want


def test_report_contexts(spark):
    """Contexts grow edge by edge and stop at the first that doesn't fit."""
    members, edges = context_queries.report_context_rows(spark, SF, 0)
    ms, es = members.collect(), sorted(edges.collect(), key=lambda e: e.pos)
    got = {r.community: r.context for r in registry.queries()["q89_tight_report_contexts"](spark, SF).collect()}
    for community in {m.community for m in ms}:
        own = {m.title: m for m in ms if m.community == community}
        level = next(m.level for m in own.values())
        at = {m.title for m in ms if m.level == level}
        inside = [e for e in es if e.source in at and e.target in at]
        first = {}
        for t in own:
            e = next((e for e in inside if e.source == t), None) or next((e for e in inside if e.target == t), None)
            if e:
                first[e.id] = e
        heads, lines, kept = [], [], ""
        for e in sorted(first.values(), key=lambda e: (-e.combined_degree, e.human_readable_id)):
            heads += [h for t in (e.source, e.target) if t in own and (h := f"{own[t].human_readable_id},{t},{own[t].description or 'No Description'}") not in heads]
            lines.append(f"{e.human_readable_id},{e.source},{e.target},{e.description},{e.combined_degree}")
            text = "\n".join(["-----Entities-----", "human_readable_id,title,description", *heads, "", "-----Relationships-----", "human_readable_id,source,target,description,combined_degree", *lines])
            if len(text) > 2_000 and kept:
                break
            kept = text
            if len(text) > 2_000:
                break
        assert got.get(community, "") == kept


def test_budget_over_ranges(spark):
    """A budget without groups is kept over ranges of the order as in one run."""
    rnd = random.Random(5)
    costs = [rnd.randrange(0, 9) for _ in range(3_000)]
    df = spark.createDataFrame(list(enumerate(costs)), "at int, c int").repartition(8)
    want, run = [], 0
    for i, c in enumerate(costs):
        if (run := run + c) > 4_000:
            break
        want.append(i)
    assert sorted(r["at"] for r in O.prefix_budget(df, "c", 4_000, ["at"]).collect()) == want
    assert O.prefix_budget(df.filter(F.col("c") < 0), "c", 10, ["at"]).count() == 0


def test_report_contexts_of_a_hot_community(spark):
    """One community with nearly all edges sends no more of them than the budget can hold; odd values are quoted or empty."""
    n = 3_000
    members = [(0, 1, f"n{i}", i, None if i % 3 else 'says "x", y') for i in range(n)] + [(0, 2, "lone", n, "d"), (0, 3, "a", n + 1, ""), (0, 3, "b", n + 2, "two\nlines")]
    edges = [(f"e{i}", i, i, f"n{i}", f"n{(i + 1) % n}", None if i % 2 else "d,", i % 50) for i in range(n)] + [("f", n, n, "a", "b", "x" * 90, 1)]
    m = spark.createDataFrame(members * 2, "level int, community long, title string, human_readable_id long, description string")
    e = spark.createDataFrame(edges, "id string, human_readable_id long, pos long, source string, target string, description string, combined_degree long")
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v

    def grown(budget, community):
        own = {t: f"{h},{t},{quote('No Description' if d is None else d)}" for _, c, t, h, d in members if c == community}
        heads, lines, kept = [], [], None
        for _, h, _, s, t, d, deg in sorted((x for x in edges if x[3] in own), key=lambda x: (-x[6], x[1])):
            heads += [own[x] for x in (s, t) if own[x] not in heads]
            lines.append(f"{h},{s},{t},{quote(d or '')},{deg}")
            text = "\n".join(["-----Entities-----", "human_readable_id,title,description", *heads, "", "-----Relationships-----", "human_readable_id,source,target,description,combined_degree", *lines])
            if len(text) > budget:
                return text if kept is None else kept
            kept = text
        return kept

    for budget in (10, 400, 3_000):
        got = {r.community: r.context for r in C.report_contexts(m, e, budget).collect()}
        assert got == {1: grown(budget, 1), 3: grown(budget, 3)}
    listed = e.withColumnsRenamed({"id": "edge_id", "human_readable_id": "eid"}).selectExpr("*", "0 level", "1L community")
    assert sorted(r["at"] for r in C.first_edges(listed, 40).collect()) == list(range(1, 41))
    assert C.report_contexts(m.filter("level < 0"), e, 100).count() == 0


def test_communities_in_a_task_and_by_joins(spark):
    """Both ways hold what is promised: a path with a triangle far off, whole in a task, by components, and by joins alone."""
    edges = [(f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(12)] + [("x0", "x1", 3.0), ("x1", "x2", 3.0), ("x0", "x2", 3.0)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    parted = [{r.node: r.c for r in L.communities_of(df, whole=w).collect()} for w in (100, 12, 3, 0)]
    assert parted[0] == parted[1] and all(len(c) == 16 and {c["x0"], c["x1"], c["x2"]} == {"x0"} for c in parted)
    assert all(held_communities(edges, c) > 0.5 and all(c[n] == min(m for m in c if c[m] == c[n]) for n in c) for c in parted)


def test_clusters_take_few_jobs(spark):
    """Bounded graphs are parted in tasks, not by a job a step: 1,049 jobs at scale factor 0.001 before."""
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    registry.queries()["q17_clusters"](spark, "/root/testdata/sf0.001").collect()
    assert jobs() - before < 250


def test_large_graphs_end_in_a_task(spark):
    """What joins have made of a graph over ``whole`` goes on in a task as soon as it fits, and clusters below it are split to their end in one."""
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    rnd = random.Random(7)
    pairs = {tuple(sorted(rnd.sample(range(40 * g, 40 * g + 40), 2))) for g in range(12) for _ in range(200)} | {(40 * g, 40 * g - 1) for g in range(1, 12)}
    edges = [(f"n{min(p):03d}", f"n{max(p):03d}", 1.0) for p in pairs]
    df, before = spark.createDataFrame(edges, "a string, b string, weight double"), jobs()
    c = {r.node: r.c for r in L.communities_of(df, whole=1_500).collect()}
    assert jobs() - before < 200
    assert len(edges) > 1_500 and held_communities(edges, c) > 0.8 and all(c[n] == min(m for m in c if c[m] == c[n]) for n in c)
    before = jobs()
    rows = G.hierarchical_clusters(df).collect()
    assert jobs() - before < 60 and max(r.level for r in rows) >= 1


def test_first_edges_in_one_pass(spark):
    """Edges are gone through once where each title's first edge serves all its levels; where it does not, the next that does is found."""
    members = [(0, 1, x, i, x) for i, x in enumerate("abcd")] + [(1, 9, x, i, x) for i, x in enumerate("acd")]
    rows = [("e1", 1, "a", "b"), ("e2", 2, "d", "a"), ("e3", 3, "a", "c"), ("e4", 4, "c", "gone"), ("e5", 5, "b", "d")]
    m = spark.createDataFrame(members, "level int, community long, title string, human_readable_id long, description string")
    e = spark.createDataFrame([(i, p, p, s, t, i, 7) for i, p, s, t in rows], "id string, human_readable_id long, pos long, source string, target string, description string, combined_degree long")

    def want(level):
        at = {x for l, _, x, *_ in members if l == level}
        found = {x: sorted((x != s, p, i) for i, p, s, t in rows if {s, t} <= at and x in (s, t)) for x in at}
        return {(level, x, f[0][2]) for x, f in found.items() if f}

    assert {(r.level, r.title, r.id) for r in C.level_first_edges(m, e).collect()} == want(0) | want(1)
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    flat = [r for r in rows if "gone" not in r]
    counted = e.filter("target <> 'gone'").mapInPandas(passed, e.schema)
    got = {r.community: r.context for r in C.report_contexts(m.filter("level = 0"), counted, 1 << 40).collect()}
    assert list(got) == [1] and seen.value == len(flat)


def test_edges_found_by_number_give_the_same_contexts(spark):
    """Contexts of the edges that are some title's first are those of all edges."""
    every, few = context_queries.report_context_rows(spark, SF, 0), context_queries.report_first_edges(spark, SF)
    assert few[1].columns == every[1].columns and 0 < few[1].count() < every[1].count()
    assert few[1].exceptAll(every[1]).isEmpty()
    texts = lambda rows: {r.community: r.context for r in C.report_contexts(*rows, 1 << 40).collect()}
    assert texts(few) == texts(every)


def test_merged_relationships_are_dealt_twice(spark):
    """Merged pairs are dealt by source once and by target once, whatever the sides' sizes; degrees count pairs without known ends."""
    rows = lambda ids: spark.createDataFrame([(f"e{i}", i, f"s{i % 4}", f"t{i % 3}", float(i), f"d{i}", [f"u{i}"]) for i in ids], "id string, human_readable_id long, source string, target string, weight double, description string, text_unit_ids array<string>")
    known = spark.createDataFrame([(x,) for x in ("s0", "s1", "s2", "t0", "t1")], "title string")
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = U.merge_relationships(rows(range(5)), rows(range(3, 15)), known)
        plan = made._jdf.queryExecution().executedPlan().toString()
        got = {(r.source, r.target): (r.id, r.weight, r.descriptions, r.combined_degree) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    by = defaultdict(list)
    for i in [*range(5), *range(3, 15)]:
        by[f"s{i % 4}", f"t{i % 3}"].append(i)
    out, into = ({x: sum(k[e] == x for k in by) for x in {k[e] for k in by}} for e in (0, 1))
    ends = {"s0", "s1", "s2", "t0", "t1"}
    assert got == {k: (f"e{v[0]}", sum(v) / len(v), [f"d{i}" for i in v], out[k[0]] + into[k[1]]) for k, v in by.items() if set(k) <= ends}
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "(title" not in x and "__r" not in x]) <= 4  # those of the two sides' titles too
