"""Rooted patterns counted by the orbit job, one per edge orbit.

Each value is the pattern of a per-directed-edge column: node 0 is the tail, node 1 the head, the
other nodes are summed over. The column's Spark expression lives in ``operators.orbits``.
"""

# Four-node system and below.
SMALL = {
    "one": "01",
    "path3": "01 12",
    "tri": "01 02 12",
    "path4_end": "01 12 23",
    "path4_mid": "01 02 13",
    "claw": "01 12 13",
    "c4": "01 12 23 03",
    "paw_tail": "01 12 13 23",
    "paw_far": "01 02 12 23",
    "paw_side": "01 02 12 13",
    "diamond_rim": "01 02 12 13 23",
    "diamond_spine": "01 02 12 03 13",
    "k4": "01 02 03 12 13 23",
}

LARGE = SMALL | {
    "path5_end": "01 12 23 34",
    "path5_mid": "01 02 13 34",
    "fork_tail": "01 12 23 24",
    "fork_leaf": "01 12 13 34",
    "fork_mid": "01 02 13 14",
    "star": "01 12 13 14",
    "bull_tail": "01 12 23 13 24",
    "bull_side": "01 12 02 13 24",
    "bull_base": "01 02 12 03 14",
    "tadpole_end": "01 12 23 24 34",
    "tadpole_mid": "01 02 13 14 34",
    "tadpole_far": "01 02 12 23 34",
    "tadpole_side": "01 02 12 13 34",
    "cricket_leaf": "01 12 13 14 34",
    "cricket_far": "01 02 12 23 24",
    "cricket_side": "01 02 12 13 14",
    "c5": "01 12 23 34 04",
    "banner_tail": "01 12 23 34 14",
    "banner_far": "01 12 23 03 24",
    "banner_side": "01 12 23 03 14",
    "dart_tail": "01 12 13 23 14 34",
    "dart_rim": "01 02 12 13 23 24",
    "dart_side": "01 02 12 13 23 14",
    "dart_spine": "01 02 12 03 13 14",
    "butterfly_far": "01 02 12 23 24 34",
    "butterfly_side": "01 02 12 13 14 34",
    "kite_tail": "01 12 13 23 24 34",
    "kite_far": "01 02 12 13 23 34",
    "kite_side": "01 02 12 13 23 04",
    "kite_spine": "01 02 12 03 13 24",
    "k23": "01 12 03 23 04 24",
    "house_roof": "01 02 12 23 34 14",
    "house_beam": "01 02 12 13 34 04",
    "house_wall": "01 12 23 03 14 24",
    "house_floor": "01 12 23 03 24 34",
    "book_page": "01 02 12 13 23 14 24",
    "book_spine": "01 02 12 03 13 04 14",
    "k4_tail": "01 12 13 14 23 24 34",
    "k4_tail_far": "01 02 03 12 13 23 24",
    "k4_tail_side": "01 02 03 12 13 23 14",
    "gem_end": "01 02 12 13 23 24 34",
    "gem_side": "01 02 12 13 23 14 34",
    "gem_mid": "01 02 12 03 23 14 24",
    "gem_spoke": "01 02 12 13 23 04 14",
    "k23e_tip": "01 12 03 04 23 24 34",
    "k23e_side": "01 12 03 13 23 04 24",
    "k23e_base": "01 02 12 03 13 24 34",
    "k4_cap_tip": "01 02 12 13 14 23 24 34",
    "k4_cap_base": "01 02 03 12 13 23 24 34",
    "k4_cap_side": "01 02 03 12 13 23 14 24",
    "k4_cap_spine": "01 02 03 12 13 23 04 14",
    "wheel_rim": "01 02 12 23 13 04 24 34",
    "wheel_spoke": "01 12 13 14 03 23 24 04",
    "k5e_side": "01 02 03 12 13 23 14 24 34",
    "k5e_core": "01 02 12 03 13 23 04 14 24",
    "k5": "01 02 03 04 12 13 14 23 24 34",
}
