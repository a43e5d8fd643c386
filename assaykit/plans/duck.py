"""DuckDB SQL renderings of the column functions, for the oracle.

An independent second implementation of each rule in plain SQL; the
oracle compares Spark results against these on the same Parquet tables.
"""
from __future__ import annotations

import math

from ..functions.conditions import (ACETIC_WORDS, AMMONIA_WORDS, CONDITION_HINTS, DMSO_WORDS,
                                    DPBS_WORDS, FORMIC_WORDS, PBS_WORDS, SALINE_WORDS,
                                    WATER_WORDS)
from ..functions.labels import (LABEL_NEGATIVE_CJK, LABEL_NULL_COMPACT, LABEL_POSITIVE_CJK,
                                STRICT_NEGATIVE, STRICT_POSITIVE)
from ..functions.sequence import (AA_WEIGHTS, AMINO_ACIDS, AVG_RESIDUE_MASS, BASELINE_CLASSES,
                                  KYTE_DOOLITTLE, PKA, RESIDUE_GROUPS, WATER_MASS)
from ..functions.text import NULL_TOKENS, NUMBER_PATTERN, QUANTITY_PATTERN, WEIRD_CHARS, WS_CLASS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def rr(e: str, pat: str, rep: str) -> str:
    return f"regexp_replace({e}, {lit(pat)}, {lit(rep)}, 'g')"


def clean_text(e: str) -> str:
    s = f"replace(replace({e}, chr(65279), ''), chr(160), ' ')"
    return f"trim({rr(s, f'[{WS_CLASS}]+', ' ')})"


def clean_cell(e: str) -> str:
    c = clean_text(e)
    return f"(CASE WHEN {c} IN {in_list(NULL_TOKENS)} THEN NULL ELSE {c} END)"


def upper(e: str) -> str:
    # Java/Python upper-case 'ß' to 'SS'; DuckDB does not.
    return f"upper(replace({e}, 'ß', 'SS'))"


def normalize_sequence(e: str) -> str:
    return f"coalesce({rr(upper(clean_text(e)), f'[{WS_CLASS}]+', '')}, '')"


def letters_only(e: str) -> str:
    return f"coalesce({rr(upper(e), '[^\\p{L}]', '')}, '')"


def cjk_count(e: str) -> str:
    return f"(length({e}) - length({rr(e, '[一-鿿]', '')}))"


def weird_count(e: str) -> str:
    return f"(length({e}) - length({rr(e, '[' + WEIRD_CHARS + ']', '')}))"


def normalize_label(e: str) -> str:
    s = clean_text(e)
    low = f"lower({s})"
    comp = rr(low, f"[{WS_CLASS}_\\-]+", "")
    neg = (f"contains({comp}, 'insoluble') OR contains({low}, 'not soluble') OR "
           + " OR ".join(f"contains({s}, {lit(w)})" for w in LABEL_NEGATIVE_CJK))
    pos = f"contains({comp}, 'soluble') OR " + " OR ".join(f"contains({s}, {lit(w)})"
                                                          for w in LABEL_POSITIVE_CJK)
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' THEN NULL "
            f"WHEN {comp} IN {in_list(LABEL_NULL_COMPACT)} THEN NULL "
            f"WHEN {neg} THEN 0 WHEN {pos} THEN 1 ELSE NULL END)")


def normalize_label_strict(e: str) -> str:
    ws = f"[{WS_CLASS}]"
    v = f"lower({rr(f'CAST({e} AS VARCHAR)', f'^{ws}+|{ws}+$', '')})"
    num = f"TRY_CAST({v} AS DOUBLE)"
    return (f"(CASE WHEN {e} IS NULL THEN NULL WHEN {v} IN {in_list(STRICT_POSITIVE)} THEN 1 "
            f"WHEN {v} IN {in_list(STRICT_NEGATIVE)} THEN 0 WHEN {num} = 1.0 THEN 1 "
            f"WHEN {num} = 0.0 THEN 0 ELSE NULL END)")


def parse_number(e: str) -> str:
    m = f"regexp_extract({clean_text(e)}, {lit(NUMBER_PATTERN)}, 0)"
    return f"(CASE WHEN {m} = '' THEN NULL ELSE TRY_CAST({m} AS DOUBLE) END)"


def parse_quantity_mg(e: str) -> str:
    s = f"replace(replace(replace(lower({clean_text(e)}), '×', '*'), 'x', '*'), ' ', '')"
    P = lit(QUANTITY_PATTERN)
    ns, am, un = (f"regexp_extract_all({s}, {P}, {i})" for i in (1, 2, 3))
    n_i = f"coalesce(({ns})[i], '')"
    u_i = f"coalesce(({un})[i], '')"
    a_i = f"CAST(({am})[i] AS DOUBLE)"
    term = (f"(CASE WHEN {n_i} = '' THEN CAST(1.0 AS DOUBLE) ELSE CAST({n_i} AS DOUBLE) END) * "
            f"(CASE WHEN {u_i} = 'g' THEN {a_i} * 1000.0 WHEN {u_i} IN ('ug', 'µg', 'μg') "
            f"THEN {a_i} / 1000.0 ELSE {a_i} END)")
    total = (f"list_reduce(range(1, len({am}) + 1), lambda acc, i: acc + {term}, "
             f"CAST(0.0 AS DOUBLE))")
    return f"(CASE WHEN {s} IS NULL OR len({am}) = 0 THEN NULL ELSE {total} END)"


def slugify(e: str) -> str:
    s = f"lower(coalesce({clean_text(e)}, 'None'))"
    s = f"replace(replace({s}, '%', 'pct'), '+', 'plus')"
    s = rr(rr(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = f"(CASE WHEN {s} = '' THEN 'unknown' ELSE {s} END)"
    return f"(CASE WHEN regexp_matches({s}, '^[0-9]') THEN 's_' || {s} ELSE {s} END)"


def stable_id(prefix: str, *parts: str) -> str:
    text = parts[0] if len(parts) == 1 else "concat_ws('|', " + ", ".join(
        f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"('{prefix}_' || substr(sha1({text}), 1, 12))"


def has_hint(e: str) -> str:
    return "(" + " OR ".join(f"contains(lower({e}), {lit(h)})" for h in CONDITION_HINTS) + ")"


def condition_class(e: str) -> list[tuple[str, str]]:
    low = f"lower({e})"

    def any_(ws):
        return "(" + " OR ".join(f"contains({low}, {lit(w)})" for w in ws) + ")"
    water, dpbs, saline, dmso = any_(WATER_WORDS), any_(DPBS_WORDS), any_(SALINE_WORDS), any_(DMSO_WORDS)
    pbs = f"(NOT {dpbs} AND {any_(PBS_WORDS)})"
    formic, acetic, ammonia = any_(FORMIC_WORDS), any_(ACETIC_WORDS), any_(AMMONIA_WORDS)
    cls = (f"CASE WHEN {ammonia} THEN 'ammonia_water' WHEN {acetic} THEN 'acetic_acid' "
           f"WHEN {formic} THEN 'formic_acid' WHEN {dmso} THEN 'dmso' WHEN {saline} THEN 'saline' "
           f"WHEN {dpbs} THEN 'dpbs' WHEN {pbs} THEN 'pbs' WHEN {water} THEN 'water' ELSE 'unknown' END")

    def f(b):
        return f"CAST(CASE WHEN {b} THEN 1 ELSE 0 END AS INTEGER)"
    return [("solvent_class", cls),
            ("is_aqueous", f(f"{water} OR {dpbs} OR {pbs} OR {saline} OR {acetic} OR {ammonia}")),
            ("is_buffer", f(f"{dpbs} OR {pbs}")),
            ("is_salt_containing", f(f"{dpbs} OR {pbs} OR {saline}")),
            ("is_organic", f(f"{dmso} OR {formic}")),
            ("is_acidic_condition", f(f"{formic} OR {acetic}")),
            ("is_basic_condition", f(ammonia))]


# ---------------------------------------------------------------------------
# Sequence descriptors (QC family) over a cleaned sequence column ``s``.
# Stage 1 adds counts; stage 2 derives descriptors from them.
# ---------------------------------------------------------------------------
def count(s: str, aa: str) -> str:
    return f"CAST(length({s}) - length(replace({s}, '{aa}', '')) AS BIGINT)"


def is_canonical(s: str) -> str:
    return f"coalesce(regexp_full_match({s}, '[{AMINO_ACIDS}]+'), false)"


def noncanonical_symbols(s: str) -> str:
    rest = rr(s, f"[{AMINO_ACIDS}]", "")
    return (f"array_to_string(list_sort(list_distinct(list_filter(string_split({rest}, ''), "
            f"lambda ch: ch <> ''))), '')")


def max_run(s: str, residues: str) -> str:
    return (f"CAST(coalesce(list_max(list_transform(regexp_extract_all({s}, '([{residues}]+)', 1), "
            f"lambda r: length(r))), 0) AS BIGINT)")


def peptide_stage1(s: str) -> list[str]:
    return ([f"CAST(length({s}) AS BIGINT) AS length_raw", f"{is_canonical(s)} AS is_canonical_aa",
             f"{noncanonical_symbols(s)} AS noncanonical_symbols"]
            + [f"{count(s, a)} AS count_{a}" for a in AMINO_ACIDS])


def dl(x: float) -> str:
    """A DOUBLE literal (a bare 1.5 is DECIMAL in DuckDB)."""
    return f"CAST({x!r} AS DOUBLE)"


def _dv(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def net_charge(ph: str) -> str:
    def basic(pka):
        return f"(1.0 / (1.0 + pow(10.0, {ph} - {dl(pka)})))"

    def acidic(pka):
        return f"(1.0 / (1.0 + pow(10.0, {dl(pka)} - {ph})))"
    pos = basic(PKA["n_term"]) + "".join(f" + count_{a} * {basic(PKA[a])}" for a in "KRH")
    neg = acidic(PKA["c_term"]) + "".join(f" + count_{a} * {acidic(PKA[a])}" for a in "DECY")
    return f"(({pos}) - ({neg}))"


def isoelectric_point() -> str:
    mid = "((acc.lo + acc.hi) / 2.0)"
    step = (f"CASE WHEN {net_charge(mid)} > 0 THEN {{'lo': {mid}, 'hi': acc.hi}} "
            f"ELSE {{'lo': acc.lo, 'hi': {mid}}} END")
    r = (f"list_reduce(range(70), lambda acc, i: {step}, "
         f"{{'lo': CAST(0.0 AS DOUBLE), 'hi': CAST(14.0 AS DOUBLE)}})")
    return f"(({r}).lo + ({r}).hi) / 2.0"


def peptide_stage2(s: str) -> list[str]:
    L = "CAST(length_raw AS DOUBLE)"
    mass = (" + ".join(f"count_{a} * {dl(AVG_RESIDUE_MASS[a])}" for a in AMINO_ACIDS)
            + f" + {dl(WATER_MASS)}")
    kd = " + ".join(f"count_{a} * {dl(KYTE_DOOLITTLE[a])}" for a in AMINO_ACIDS)
    kd2 = " + ".join(f"count_{a} * {dl(KYTE_DOOLITTLE[a] ** 2)}" for a in AMINO_ACIDS)
    gravy = _dv(f"({kd})", L)
    var = f"greatest({_dv(f'({kd2})', L)} - {gravy} * {gravy}, 0.0)"
    ent = " + ".join(f"(CASE WHEN count_{a} > 0 THEN -{_dv(f'count_{a}', L)} * log2({_dv(f'count_{a}', L)}) "
                     f"ELSE 0.0 END)" for a in AMINO_ACIDS)
    q7 = net_charge("7.0")
    npos, nneg = "(count_K + count_R + count_H)", "(count_D + count_E)"

    def g(e, name):
        return f"CASE WHEN is_canonical_aa THEN CAST({e} AS DOUBLE) ELSE NULL END AS {name}"
    out = [g(_dv(f"count_{a}", L), f"frac_{a}") for a in AMINO_ACIDS]
    out += [g(L, "length"), g(f"({mass})", "mw_calc_avg"), g(gravy, "gravy"),
            g(f"sqrt({var})", "hydropathy_std"), g(f"({ent})", "sequence_entropy"),
            g(f"({ent}) / {math.log2(20)!r}", "sequence_entropy_norm20"),
            g(q7, "net_charge_pH7"), g(f"abs({q7})", "abs_net_charge_pH7"),
            g(_dv(q7, L), "charge_per_residue_pH7"), g(isoelectric_point(), "pI_calc"),
            g(_dv(f"({npos} + {nneg})", L), "fcr"), g(_dv(f"({npos} - {nneg})", L), "ncpr")]
    for name, res in RESIDUE_GROUPS.items():
        n = "(" + " + ".join(f"count_{a}" for a in res) + ")"
        out += [g(n, f"count_{name}"), g(_dv(n, L), f"frac_{name}"),
                g(max_run(s, res), f"max_run_{name}")]
    return out


def baseline_stage1(letters: str) -> list[str]:
    return ([f"CAST(length({letters}) AS BIGINT) AS seq_length"]
            + [f"{count(letters, a)} AS count_{a}" for a in AMINO_ACIDS])


def baseline_stage2() -> list[str]:
    n = "CAST(seq_length AS DOUBLE)"
    known = "CAST(" + " + ".join(f"count_{a}" for a in AMINO_ACIDS) + " AS DOUBLE)"
    mw = " + ".join(f"count_{a} * {dl(AA_WEIGHTS[a])}" for a in AMINO_ACIDS)
    kd = " + ".join(f"count_{a} * {dl(KYTE_DOOLITTLE[a])}" for a in AMINO_ACIDS)
    net = "((count_K + count_R + count_H) - (count_D + count_E))"

    def z(e, name, zero="0.0"):
        return f"CAST(CASE WHEN seq_length = 0 THEN {zero} ELSE {e} END AS DOUBLE) AS {name}"
    out = [f"CAST(seq_length AS DOUBLE) AS seq_length", z(f"({mw})", "mw_approx"),
           z(f"(CASE WHEN {known} > 0 THEN {_dv(f'({kd})', known)} ELSE 0.0 END)", "hydropathy_mean"),
           z(_dv(f"greatest({n} - {known}, 0.0)", n), "frac_unknown", "1.0")]
    for name in ["hydrophobic", "polar", "positive", "negative", "charged", "aromatic",
                 "glycine", "proline"]:
        c = "(" + " + ".join(f"count_{a}" for a in BASELINE_CLASSES[name]) + ")"
        out.append(z(_dv(c, n), f"frac_{name}"))
    out += [z(net, "net_charge_proxy"), z(f"abs({net})", "abs_net_charge_proxy")]
    out += [f"CAST(count_{a} AS DOUBLE) AS count_{a}" for a in AMINO_ACIDS]
    out += [z(_dv(f"count_{a}", n), f"frac_{a}") for a in AMINO_ACIDS]
    return out
