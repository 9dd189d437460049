"""Schemas of the engine's tables."""

BLOCKS = (
    "pos int, tag string, cls string, html string, text string, type string, level int, src string, caption string, junk boolean, "
    "cap_consumed boolean, src_a int, box string, in_list boolean"
)
LINKS = "pair_idx int, src array<int>, tgt array<int>, r double, c double"
