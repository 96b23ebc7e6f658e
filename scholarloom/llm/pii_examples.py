"""A small table of labelled sentences, made by rule: invented words around personal data in several forms, and around numbers that are none."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SENTENCES = 600
EXAMPLES_DDL = "text string, spans array<struct<kind:string,start:long,end:long>>"


def luhn_number(draw: random.Random, digits: int, passes: bool = True) -> str:
    body = [draw.randrange(10) for _ in range(digits - 1)]
    body[0] = draw.choice([3, 4, 5, 6])
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(body)))
    check = -total % 10
    return "".join(map(str, body)) + str(check if passes else (check + draw.randrange(1, 10)) % 10)


class Maker:
    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.draw.choice("0123456789") for _ in range(n))

    def letters(self, low: int, high: int) -> str:
        return "".join(self.draw.choice(["th", "er", "on", "é", "ing", "ß", "a", "re", "que", "sch", "ción", "o"]) for _ in range(self.draw.randint(low, high)))

    def word(self) -> str:
        made = self.letters(1, 4)
        return made.capitalize() if self.draw.random() < 0.15 else made

    def plain(self, low: int, high: int) -> str:
        return "".join(self.draw.choice(["th", "er", "on", "in", "mar", "a", "re", "lo"]) for _ in range(self.draw.randint(low, high)))

    def email(self) -> str:
        name = self.plain(1, 4) + self.draw.choice(["", "." + self.plain(1, 3), self.digits(2), "." + self.digits(2)])
        host, end = self.plain(1, 3) + self.draw.choice(["", self.digits(1)]), self.draw.choice(["com", "org", "net", "de", "fr"])
        at, dot = self.draw.choice(["(at)", "[at]", "{at}"]), self.draw.choice(["(dot)", "[dot]", "{dot}"])
        return self.draw.choice([f"{name}@{host}.{end}", f"{name}@{host}.example.{end}", f"{name} {at} {host} {dot} {end}", f"{name}{at}{host}{dot}{end}", f"{name} {at} {host}.{end}", f"{name}{at}{host}.{end}"])

    def ip(self) -> str:
        short = ".".join(str(self.draw.randrange(256)) for _ in range(4))
        group = lambda: "%x" % self.draw.randrange(1, 65536)
        return self.draw.choice([short, short, ":".join(group() for _ in range(8)), "2001:db8::" + ":".join(group() for _ in range(self.draw.randint(2, 4))), "fe80::" + ":".join(group() for _ in range(4))])

    def card(self) -> str:
        number = luhn_number(self.draw, 16)
        parts = [number[k:k + 4] for k in range(0, 16, 4)]
        return self.draw.choice([number, number, " ".join(parts), "-".join(parts), luhn_number(self.draw, 15)])

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.draw.choice([f"+{self.draw.randint(1, 99)} ({a}) {b}-{c}", f"+{self.draw.randint(1, 99)} ({a}) {b}-{c}", f"+{self.draw.randint(1, 99)} {a} {b} {c}", f"+{self.digits(11)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{self.digits(2)} {self.digits(2)} {self.digits(7)}"])

    def other(self) -> str:
        """Numbers and marks that are no personal data."""
        d, letter = self.digits, self.draw.choice("ABCXYZv")
        return self.draw.choice([
            luhn_number(self.draw, 16, False), luhn_number(self.draw, 16, False), luhn_number(self.draw, 15, False), f"20{d(2)}-0{self.draw.randint(1, 9)}-{self.draw.randint(10, 28)}", f"{self.draw.randint(10, 28)}.0{self.draw.randint(1, 9)}.20{d(2)}",
            f"{self.draw.randint(10, 23)}:{self.draw.randint(10, 59)}:{self.draw.randint(10, 59)}", f"{letter}{d(1)}.{d(1)}.{d(1)}", f"${d(2)}.{d(2)}", f"19{d(2)}", f"({d(4)})", f"[{d(2)}]", f"{letter}-{d(4)}", f"{d(2)}-{d(2)}",
            f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", f"3{d(2)}.4{d(2)}.{d(2)}.{d(1)}", f"{d(1)},{d(3)},{d(3)}", f"{d(2)}%", d(self.draw.randint(1, 6)), d(10), f'"{"%032x" % self.draw.getrandbits(128)}"', f"{'%08x' % self.draw.getrandbits(32)}",
            f"http://{self.plain(1, 3)}.org/{d(2)}", f"{self.plain(1, 2)}::{self.plain(1, 3)}", ":".join("%02x" % self.draw.randrange(256) for _ in range(6)), f"{self.plain(1, 2)}({self.plain(1, 2)})", f"(at {self.plain(1, 2)})", f"@{self.plain(1, 3)}",
            f"{d(3)} {d(3)} {d(2)}", f"{d(2)} + {d(2)}", f"978-3-{d(2)}-{d(6)}-{d(1)}", "###", "$$$", f"{self.plain(1, 2)}/{self.plain(1, 2)}", f"{self.plain(1, 2)}=", "|", "--"])

    def sentence(self) -> tuple[str, list[tuple[str, int, int]]]:
        text, spans = "", []
        for _ in range(self.draw.randint(1, 3)):
            for _ in range(self.draw.randint(1, 5)):
                text += self.word() + self.draw.choice([" ", " ", " ", " ", ", ", ". "])
            for _ in range(self.draw.choice([1, 1, 1, 2])):
                kind = self.draw.choice(["email", "ip", "card", "phone", "phone", "", "", "", ""])
                made = getattr(self, kind or "other")()
                quote = self.draw.choice(["", "", "", "", '"', "<"])
                text += quote
                if kind:
                    spans.append((kind, len(text), len(text) + len(made)))
                text += made + {"": "", '"': '"', "<": ">"}[quote] + self.draw.choice([" ", " ", " ", ", ", ". ", "!! ", "### "])
        return text + self.word() + ".", spans


def labelled(spark: SparkSession, seed: int = 13, sentences: int = SENTENCES) -> DataFrame:
    """(text, spans) of sentences drawn by ``seed``; spans in code points, end exclusive."""
    maker = Maker(seed)
    return spark.createDataFrame([maker.sentence() for _ in range(sentences)], EXAMPLES_DDL)
