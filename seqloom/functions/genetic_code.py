"""Genetic codes by NCBI number, built from the standard one and the codons in which each differs."""

from __future__ import annotations

from itertools import product

CODONS = ["".join(c) for c in product("TCAG", repeat=3)]
# Letters of the standard code in the order of CODONS.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# By table, codons that mean another letter, and start codons.
DIFFERENT = {
    1: "", 2: "AGA* AGG* ATAM TGAW", 3: "ATAM CTTT CTCT CTAT CTGT TGAW", 4: "TGAW", 5: "AGAS AGGS ATAM TGAW", 6: "TAAQ TAGQ",
    9: "AAAN AGAS AGGS TGAW", 10: "TGAC", 11: "", 12: "CTGS", 13: "AGAG AGGG ATAM TGAW", 14: "AAAN AGAS AGGS TAAY TGAW", 16: "TAGL",
    21: "AAAN AGAS AGGS ATAM TGAW", 22: "TCA* TAGL", 23: "TTA*", 24: "AGAS AGGK TGAW", 25: "TGAG", 26: "CTGA", 27: "TAAQ TAGQ TGAW",
    28: "TAAQ TAGQ TGAW", 29: "TAAY TAGY", 30: "TAAE TAGE", 31: "TAAE TAGE TGAW", 33: "TAAY AGAS AGGK TGAW",
}
STARTS = {
    1: "TTG CTG ATG", 2: "ATT ATC ATA ATG GTG", 3: "ATA ATG GTG", 4: "TTA TTG CTG ATT ATC ATA ATG GTG", 5: "TTG ATT ATC ATA ATG GTG", 6: "ATG",
    9: "ATG GTG", 10: "ATG", 11: "TTG CTG ATT ATC ATA ATG GTG", 12: "CTG ATG", 13: "TTG ATA ATG GTG", 14: "ATG", 16: "ATG", 21: "ATG GTG", 22: "ATG",
    23: "ATT ATG GTG", 24: "TTG CTG ATG GTG", 25: "TTG ATG GTG", 26: "CTG ATG", 27: "ATG", 28: "ATG", 29: "ATG", 30: "ATG", 31: "ATG", 33: "TTG CTG ATG GTG",
}
# Tables whose stop codons are not just those without a letter.
STOPS = {27: "TGA", 28: "TAA TAG TGA", 31: "TAA TAG"}


def genetic_code(number: int) -> dict[str, str]:
    """Triplet -> letter, '*' for stop. An unknown number raises."""
    if number not in DIFFERENT:
        raise ValueError(f"no genetic code has the number {number}")
    return dict(zip(CODONS, STANDARD)) | {x[:3]: x[3] for x in DIFFERENT[number].split()}


def start_codons(number: int) -> list[str]:
    return STARTS[number].split()


def stop_codons(number: int) -> list[str]:
    return STOPS[number].split() if number in STOPS else [c for c, a in genetic_code(number).items() if a == "*"]
