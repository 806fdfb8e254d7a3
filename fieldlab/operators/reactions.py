"""Reaction catalogs: rates of progress, source terms, network structure.

Catalogs are DataFrames: ``stoich(rxn, species, side, coeff)`` with side R or P,
``reactions(rxn, a_f, b_f, e_f, a_r, b_r, e_r, reversible)`` and
``species(species, conc, ...)``.  Joins are equi-joins on rxn or species, left to Spark to
place; catalog tables are small, yet nothing is broadcast without Spark's size check.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinetics import arrhenius
from .iterate import discard, freed_shuffles, keep


def add_unique(catalog: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Both catalogs; fails, when run, if a key occurs twice."""
    both = catalog.unionByName(more)
    twice = both.groupBy(key).agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_most"))
    checked = both.crossJoin(F.broadcast(twice))  # one row
    return checked.where(F.when(F.col("_most") > 1, F.raise_error("a key exists already").cast("boolean")).otherwise(F.lit(True))).drop("_most")


def touching(stoich: DataFrame, species, side: str | None = None) -> DataFrame:
    """Reactions of a species, once for each side it stands on."""
    rows = stoich.where(F.col("species") == species)
    return (rows if side is None else rows.where(F.col("side") == side)).select("rxn", "side")


def all_species(stoich: DataFrame) -> DataFrame:
    return stoich.select("species").distinct()


def fast_species(stoich: DataFrame, reactions: DataFrame, T: float, threshold: float = 1e10) -> DataFrame:
    fast = reactions.where(arrhenius("a_f", "b_f", "e_f", T) > threshold)
    return stoich.join(fast.select("rxn"), "rxn", "left_semi").select("species").distinct()


def net_stoichiometry(stoich: DataFrame) -> DataFrame:
    """(rxn, species, nu): products less reactants."""
    signed = F.when(F.col("side") == "P", F.col("coeff")).otherwise(-F.col("coeff"))
    return stoich.groupBy("rxn", "species").agg(F.sum(signed).alias("nu"))


def rates_of_progress(stoich: DataFrame, reactions: DataFrame, species: DataFrame, T: Column | float, on_missing: str = "error") -> DataFrame:
    """(rxn, forward, reverse, net): k times the product of conc ** coeff over a side; the
    reverse is 0 where irreversible.  A species without concentration fails the plan, or
    counts as 0 with ``on_missing='zero'``."""
    rows = stoich.join(species.select("species", "conc"), "species", "left")
    missing = F.lit(0.0) if on_missing == "zero" else F.raise_error("a species has no concentration").cast("double")
    term = F.pow(F.coalesce("conc", missing), F.col("coeff"))
    sides = rows.groupBy("rxn").agg(F.product(F.when(F.col("side") == "R", term)).alias("r"), F.product(F.when(F.col("side") == "P", term)).alias("p"))
    out = reactions.join(sides, "rxn")
    out = out.withColumn("forward", arrhenius("a_f", "b_f", "e_f", T) * F.coalesce("r", F.lit(1.0)))
    out = out.withColumn("reverse", F.when(F.col("reversible"), arrhenius("a_r", "b_r", "e_r", T) * F.coalesce("p", F.lit(1.0))).otherwise(F.lit(0.0)))
    return out.select("rxn", "forward", "reverse", (F.col("forward") - F.col("reverse")).alias("net"))


def production_rates(stoich: DataFrame, rates: DataFrame) -> DataFrame:
    """(species, rate): the sum of nu times net rate of progress."""
    rows = net_stoichiometry(stoich).join(rates.select("rxn", "net"), "rxn")
    return rows.groupBy("species").agg(F.sum(F.col("nu") * F.col("net")).alias("rate"))


def jacobian(stoich: DataFrame, reactions: DataFrame, species: DataFrame, T: Column | float, eps: float = 1e-8, n: int | None = None) -> DataFrame:
    """(species, wrt, value): the derivative of each production rate by each concentration, as
    the sparse matrix that the network leaves nonzero.

    The product rule is relational: a side's product without one of its terms is the side's
    product over that term, or, where that term alone is 0, the product of the others.  At a
    concentration of 0 a term's derivative is the forward difference over ``eps``.  Species
    without a concentration count as 0.  ``n`` partitions hold each step's rows, or Spark's number
    without it.
    """
    deal = lambda df, *by: df if n is None else df.repartition(n, *by)
    rows = deal(stoich, "species").join(deal(species.select("species", "conc"), "species"), "species", "left").withColumn("conc", F.coalesce("conc", F.lit(0.0)))
    c, nu = F.col("conc"), F.col("coeff")
    rows = rows.withColumns({"term": F.pow(c, nu), "slope": F.when(c > 0, nu * F.pow(F.when(c > 0, c), nu - 1)).otherwise(F.pow(F.lit(eps), nu - 1))})
    side = Window.partitionBy("rxn", "side")
    rows = deal(rows, "rxn").withColumns({"rest": F.coalesce(F.product(F.when(F.col("term") != 0, F.col("term"))).over(side), F.lit(1.0)), "zeros": F.count(F.when(F.col("term") == 0, 1)).over(side)})
    others = F.when(F.col("zeros") == 0, F.col("rest") / F.when(F.col("term") != 0, F.col("term"))).when((F.col("zeros") == 1) & (F.col("term") == 0), F.col("rest")).otherwise(F.lit(0.0))
    forward = arrhenius("a_f", "b_f", "e_f", T)
    reverse = F.when(F.col("reversible"), arrhenius("a_r", "b_r", "e_r", T)).otherwise(F.lit(0.0))
    partial = rows.join(deal(reactions, "rxn"), "rxn").select("rxn", F.col("species").alias("wrt"), (F.when(F.col("side") == "R", forward).otherwise(-reverse) * F.col("slope") * others).alias("d"))
    partial = partial.groupBy("rxn", "wrt").agg(F.sum("d").alias("d"))
    pairs = net_stoichiometry(deal(stoich, "rxn")).join(partial, "rxn").select("species", "wrt", (F.col("nu") * F.col("d")).alias("value"))
    return deal(pairs, "species", "wrt").groupBy("species", "wrt").agg(F.sum("value").alias("value"))


def stiffness(jacobian: DataFrame, keys: list[str] | None = None, threshold: float = 1000.0) -> DataFrame:
    """([keys], stiffness, stiff): greatest over least |diagonal| above 1e-12, 0 without any."""
    d = F.abs(F.col("value"))
    out = jacobian.where("species = wrt").groupBy(*(keys or [])).agg(F.max(F.when(d > 1e-12, d)).alias("most"), F.min(F.when(d > 1e-12, d)).alias("least"))
    ratio = F.coalesce(F.col("most") / F.col("least"), F.lit(0.0))
    return out.select(*(keys or []), ratio.alias("stiffness"), (ratio > threshold).alias("stiff"))


def source_terms(stoich: DataFrame, rates: DataFrame) -> DataFrame:
    """(species, production, consumption, net, producing, consuming): coefficients times net
    rate by side - so both may be negative - and the sorted reaction ids."""
    rows = stoich.join(rates.select("rxn", F.col("net").alias("rop")), "rxn")
    on = lambda side, value: F.coalesce(F.sum(F.when(F.col("side") == side, value)), F.lit(0.0))
    ids = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("rxn"))))
    amount = F.col("coeff") * F.col("rop")
    out = rows.groupBy("species").agg(on("P", amount).alias("production"), on("R", amount).alias("consumption"), ids("P").alias("producing"), ids("R").alias("consuming"))
    return out.withColumn("net", F.col("production") - F.col("consumption"))


def roles(stoich: DataFrame) -> DataFrame:
    """(species, role): pure reactant, pure product or intermediate."""
    sides = stoich.groupBy("species").agg(F.bool_or(F.col("side") == "R").alias("r"), F.bool_or(F.col("side") == "P").alias("p"))
    return sides.select("species", F.when(F.col("r") & F.col("p"), "intermediate").when(F.col("r"), "reactant").otherwise("product").alias("role"))


def pure(stoich: DataFrame, side: str) -> DataFrame:
    """Species of one side and never of the other: an anti-join."""
    one, other = stoich.where(F.col("side") == side), stoich.where(F.col("side") != side)
    return one.join(other.select("species"), "species", "left_anti").select("species").distinct()


def intermediates(stoich: DataFrame) -> DataFrame:
    """Species of both sides: a semi-join."""
    return stoich.where("side = 'R'").join(stoich.where("side = 'P'").select("species"), "species", "left_semi").select("species").distinct()


def unknown_references(stoich: DataFrame, species: DataFrame) -> DataFrame:
    """Stoichiometry of species that the catalog lacks."""
    return stoich.join(species.select("species"), "species", "left_anti")


def phase_counts(stoich: DataFrame, species: DataFrame) -> DataFrame:
    """(rxn, gas, liquid, solid): distinct species of a reaction by phase."""
    rows = stoich.select("rxn", "species").distinct().join(species.select("species", "phase"), "species", "left")
    return rows.groupBy("rxn").agg(*(F.count_if(F.col("phase") == p).alias(p) for p in ("gas", "liquid", "solid")))


def reaction_pairs(stoich: DataFrame) -> DataFrame:
    """(src, dst): reactant to product, once for each reaction that has both, no loops."""
    a = stoich.where("side = 'R'").select("rxn", F.col("species").alias("src"))
    b = stoich.where("side = 'P'").select("rxn", F.col("species").alias("dst"))
    return a.join(b, "rxn").where("src <> dst").select("src", "dst")


def network_edges(stoich: DataFrame) -> DataFrame:
    """(src, dst): reactant to product within a reaction, no loops."""
    return reaction_pairs(stoich).distinct()


def network_stats(stoich: DataFrame, reactions: DataFrame) -> DataFrame:
    """One row: species, reactions, edges, pure reactants, pure products, intermediates,
    reversible reactions."""
    counts = roles(stoich).agg(F.count("*").alias("n_species"), *(F.count_if(F.col("role") == k).alias(f"n_{k}s") for k in ("reactant", "product", "intermediate")))
    rx = reactions.agg(F.count("*").alias("n_reactions"), F.count_if("reversible").alias("n_reversible"))
    return counts.crossJoin(rx).crossJoin(network_edges(stoich).agg(F.count("*").alias("n_edges")))


def _places(sources: DataFrame) -> DataFrame:
    """(src, word, bit): 64 sources share a word, ranked within buckets of their hash."""
    rows = sources.select("src").distinct()
    buckets = F.lit(max(1, rows.count() // 64))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("src")) - 1
    ranked = rows.withColumn("bucket", F.pmod(F.xxhash64("src"), buckets)).withColumn("rank", rank)
    return ranked.select("src", (F.col("bucket") * (1 << 20) + F.floor(F.col("rank") / 64)).alias("word"), F.pmod("rank", F.lit(64)).cast("int").alias("bit"))


def _spread(edges: DataFrame, places: DataFrame, depth: int | None = None, each: list[DataFrame] | None = None) -> DataFrame:
    """(node, word, bits): the sources that reach a node within ``depth`` hops.  ``each`` gets a
    table of what is new at every hop; without it these are deleted once they are counted in."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    front = found = places.groupBy(F.col("src").alias("node"), "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    for _ in itertools.count(1) if depth is None else range(1, depth + 1):
        met = front.join(step, "node").groupBy(F.col("next").alias("node"), "word").agg(F.bit_or("bits").alias("met"))
        seen = F.coalesce("bits", F.lit(0).cast("long"))
        new = keep(met.join(found, ["node", "word"], "left").select("node", "word", F.col("met").bitwiseAND(F.bitwise_not(seen)).alias("bits")).where("bits <> 0"))
        if each is None:
            discard(front)
        if new.isEmpty():
            discard(new)
            break
        if each is not None:
            each.append(new)
        before, front, found = found, new, keep(found.union(new).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
        discard(before)
    return found


def _pathways(bits: DataFrame, places: DataFrame) -> DataFrame:
    """bits(node, word, bits, ...) with a row for each source ``src`` instead of its bit."""
    single = bits.withColumn("bit", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftright(bits, b) & 1) = 1)"))).drop("bits")
    return single.join(places, ["word", "bit"]).drop("word", "bit").withColumnRenamed("node", "dst")


def reachable(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst, hops): everything within ``depth`` hops of the sources(src), or at any
    distance without it, the sources themselves included with 0.

    The frontier holds, for each node, the sources that reached it as bits of 64-bit words, so a
    hop is one join and one ``bit_or``, whose rows grow with nodes times sources / 64.  Hops
    follow until one finds nothing new; each is written to the shared folder.  Every hop reads
    edges(src, dst) again, so they should stand in a table.
    """
    places, each = keep(_places(sources)), []
    discard(_spread(edges, places, depth, each))
    every = places.groupBy(F.col("src").alias("node"), "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).withColumn("hops", F.lit(0))
    for hop, new in enumerate(each, 1):
        every = every.union(new.withColumn("hops", F.lit(hop)))
    return _pathways(every, places).select("src", "dst", "hops")


def _marked(state: DataFrame, step: DataFrame, hops: int, better: Column, value: Column) -> DataFrame:
    """state(node, color, value, new) after marks went along step(node, next): a node takes the
    least value that comes to it if ``better`` (v is what comes, c its sender's color).  Each
    state that was kept is deleted once the next one is."""
    for _ in range(hops):
        sent = state.where("new").join(step.hint("merge"), "node").groupBy(F.col("next").alias("node")).agg(F.min("value").alias("v"))
        old, state = state, keep(state.join(sent.hint("merge"), "node", "left").withColumn("new", F.coalesce(better, F.lit(False))).withColumn("value", F.when(F.col("new"), value).otherwise(F.col("value"))).select("node", "color", "value", "new"))
        discard(old)
        if state.where("new").isEmpty():
            break
    return state


def strong_groups(edges: DataFrame, hops: int = 24, rounds: int = 3) -> DataFrame:
    """(node, comp): nodes that certainly reach each other share a comp, the least of them; others
    stand for themselves.

    Found from at most four edges a node, picked by hash: the least node's mark goes forward, and
    back among the nodes it came to.  Every group is strongly connected, yet part of one may be
    left out where ``hops`` or ``rounds`` end first, so this is for making graphs smaller.
    """
    mix = F.hash("src", "dst")
    ends = lambda k, o: edges.groupBy(k).agg(F.array_distinct(F.array(F.min_by(o, mix), F.max_by(o, mix))).alias("o")).select(k, F.explode("o").alias(o)).select("src", "dst")
    picks = keep(ends("src", "dst")), keep(ends("dst", "src"))
    some = keep(picks[0].union(picks[1]).distinct())
    discard(*picks)
    nodes = keep(some.select(F.col("src").alias("node")).union(some.select("dst")).distinct())
    rest, groups, many = nodes, [], nodes.count()
    for _ in range(rounds):
        state = keep(rest.select("node", F.col("node").alias("color"), F.col("node").alias("value"), F.lit(True).alias("new")))
        there = _marked(state, some.select(F.col("src").alias("node"), F.col("dst").alias("next")), hops, F.col("v") < F.col("value"), F.col("v"))
        colored = keep(there.select("node", F.col("value").alias("color")))
        at = lambda end: colored.select(F.col("node").alias(end), F.col("color").alias(f"{end}_c"))
        within = keep(some.join(at("src").hint("merge"), "src").join(at("dst").hint("merge"), "dst").where("src_c = dst_c").select("src", "dst"))
        root = F.col("node") == F.col("color")
        state = keep(colored.select("node", "color", F.when(root, F.col("color")).alias("value"), root.alias("new")))
        discard(there, some, rest)
        back = _marked(state, within.select(F.col("dst").alias("node"), F.col("src").alias("next")), hops, F.col("value").isNull() & F.col("v").isNotNull(), F.col("v"))
        groups.append(keep(back.where("value is not null").select("node", F.col("value").alias("comp"))))
        rest = keep(back.where("value is null").select("node"))
        discard(back, colored)
        if rest.count() * 100 < many:
            discard(within)
            break
        some = keep(within.join(rest.select(F.col("node").alias("src")).hint("merge"), "src", "left_semi").join(rest.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_semi"))
        discard(within)
    every = rest.select("node", F.col("node").alias("comp"))
    for group in groups:
        every = every.union(group)
    every = keep(every)
    discard(some, rest, *groups)
    return every


#: Members of a group that meet its sources in one stretch of a task.
GROUP_CHUNK = 4096


def closure(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst): what ``reachable`` finds at any distance, without the hops.

    Nodes that reach each other reach the same, so groups of them are single nodes of a smaller
    graph, and what is stored grows with the groups; pairs are made as they are read.  Groups
    meet their sources in chunks of members, so no task holds a large one.

    All but the last join is done in the call.  What a step wrote and shuffled is deleted once the
    next one has it, so the disk holds the edges and one step, however many there are.  Edges are
    read several times, so they should stand in a table; after the call they aren't read again.
    """
    with freed_shuffles(edges.sparkSession):
        sources = keep(sources.distinct())
        grouped = strong_groups(edges)
        alone = sources.select(F.col("src").alias("node")).join(grouped.select("node").hint("merge"), "node", "left_anti")
        comps = keep(grouped.union(alone.select("node", F.col("node").alias("comp"))))
        of = lambda node, comp: comps.select(F.col("node").alias(node), F.col("comp").alias(comp)).hint("merge")
        led = keep(edges.join(of("src", "a"), "src").select("a", "dst").distinct())
        small = keep(led.join(of("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        discard(grouped, led)
        asked = keep(sources.join(of("src", "a"), "src").select("src", "a"))
        discard(sources)
        places = keep(_places(asked.select(F.col("a").alias("src"))))
        reach = _pathways(_spread(small, places), places).select(F.col("src").alias("a"), F.col("dst").alias("b"))
        discard(small)
    sizes = comps.groupBy("comp").agg(F.ceil(F.count("*") / GROUP_CHUNK).alias("chunks"))
    members = comps.join(sizes.hint("merge"), "comp").select(F.col("comp").alias("b"), F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), F.col("node").alias("dst"))
    chunks = sizes.select(F.col("comp").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    pairs = asked.join(reach.hint("merge"), "a").join(chunks.hint("merge"), "b")
    return pairs.select("src", "b", "chunk").join(members.hint("merge"), ["b", "chunk"]).select("src", "dst")


def equations(stoich: DataFrame, reactions: DataFrame, name: Column) -> DataFrame:
    """(rxn, equation): ``2 A + B <=> C``, species in order of name, coefficients of 1 left
    out."""
    coeff = F.when(F.col("coeff") == 1, F.lit("")).otherwise(F.concat(F.regexp_replace(F.format_string("%.2f", "coeff"), r"\.?0+$", ""), F.lit(" ")))
    rows = stoich.withColumn("term", F.struct(name.alias("name"), F.concat(coeff, name).alias("text")))
    side = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("term")))), lambda t: t["text"]), " + ")
    out = rows.groupBy("rxn").agg(side("R").alias("left"), side("P").alias("right")).join(reactions.select("rxn", "reversible"), "rxn")
    return out.select("rxn", F.concat("left", F.when(F.col("reversible"), " <=> ").otherwise(" => "), "right").alias("equation"))


def mole_fractions(rows: DataFrame, key: str, mass_fraction: str, mw: str) -> DataFrame:
    """rows with ``x``: (Y / mw) over the key's sum."""
    part = F.col(mass_fraction) / F.col(mw)
    return rows.withColumn("x", part / F.sum(part).over(Window.partitionBy(key)))


def mass_fractions(rows: DataFrame, key: str, mole_fraction: str, mw: str) -> DataFrame:
    """rows with ``y``: X mw over the key's sum."""
    part = F.col(mole_fraction) * F.col(mw)
    return rows.withColumn("y", part / F.sum(part).over(Window.partitionBy(key)))


def heat_release(stoich: DataFrame, species: DataFrame, rates: DataFrame) -> DataFrame:
    """(rxn, enthalpy, heat): products' less reactants' formation enthalpies, and minus it
    times the rate; species outside the catalog are skipped."""
    rows = net_stoichiometry(stoich).join(species.select("species", "h_form"), "species")
    out = rows.groupBy("rxn").agg(F.sum(F.col("nu") * F.col("h_form")).alias("enthalpy")).join(rates.select("rxn", "net"), "rxn")
    return out.select("rxn", "enthalpy", (-F.col("enthalpy") * F.col("net")).alias("heat"))


def rate_limiting(steps: DataFrame, key: str, step: str, rate: str, mechanism: str) -> DataFrame:
    """(key, step, tof): the first step of the least rate; steps other than
    langmuir_hinshelwood and associative count as rate 0, and give a turnover of 0."""
    counted = F.when(F.col(mechanism).isin("langmuir_hinshelwood", "associative"), F.col(rate)).otherwise(F.lit(0.0))
    return steps.groupBy(key).agg(F.min(F.struct(counted.alias("r"), F.col(step).alias("s"))).alias("m")).select(key, F.col("m.s").alias(step), F.col("m.r").alias("tof"))
