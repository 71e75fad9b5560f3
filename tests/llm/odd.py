"""Made-up rows: prose, and cases that operators must get through."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n=120):
    x, out = seed * 7919 + 1, []
    for k in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + (str(x // 8192 % 97) if x % 3 else ""))
    return " ".join(out) + "."


def odd_rows():
    """Nulls in all columns, empty and blank texts, repeated rows, copies, near copies, very long texts and words."""
    base = prose(1)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", "a", 5), (4, base, "en", "a", len(base)), (5, base, "en", "b", len(base)), (6, base + " More.", "en", "b", 0), (7, base.upper(), "en", None, 0),
        (8, "one", "en", "a", 3), (9, "one two", "en", "a", 7), (10, "ONE\ttwo", "en", "a", 7), (11, prose(2, 30_000), "en", "c", 0), (12, "x" * 200_000, "en", "c", 0), (13, "1" * 50_000 + " @ . + " + "1-" * 30_000, "en", "c", 0),
        (14, prose(3), "en", "a", 0), (14, prose(3), "en", "a", 0), (14, prose(3), "en", "a", 0), (15, "é中😀 naïve café x\x1cy  z \n\n\n w\r\nq<|endoftext|>r\0s\n \n", "fr", "é", 0), (16, "same line\n" * 40, "en", "a", 0),
        (17, "write to a.b@c.org, b@c.d.e@f.gh or 10.0.0.256, 1.2.3.4.5, 4111 1111 1111 1111, 4111-1111-1111-1112, +1 (555) 010-7788 and +123", "en", "a", 0), (18, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. More.", "en", "a", 0),
    ]
