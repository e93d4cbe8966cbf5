"""Column sets that the operators share."""

PAIR = "pair_id long, identifier string, r1 string, r2 string, r1_qual string, r2_qual string, multiplicity long"
TARGET = "target_id int, name string, seq string, n int"
INDELS = "map<int, struct<insert: boolean, seq: string, src_index: int, ambiguous: boolean>>"
RESULT = (
    "pair_id long, target_id int, mask string, site int, `end` int, mutations array<int>, removed_mutations array<int>, "
    f"r1_indels {INDELS}, r2_indels {INDELS}, failure string, edge_mut string, edge_indel boolean, ambig_indel boolean, interesting boolean, "
    "prefix string, linker int, dumbbell int, multiplicity long, counters map<string, long>"
)
REGISTERED = "target_id int, mask string, kind string, pos int, `end` int, cnt long"
TREATED, UNTREATED = "RRRY", "YYYR"
