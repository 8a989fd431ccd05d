"""Texts that every operator has to bear."""

ODD = [None, "", " \n\t ", "x", "É x Y z", "foo  BAR", "日本語" * 50, "a<|endoftext|>b <|startoftext|>", "é" * 5000, "ab c   d\n\n" * 400, "!\x1cq  z ́k", "don't I'LL ½ ² ª 12ab"]
PROSE = ["the quick brown fox jumps over the lazy dog and runs away from it", "idiot scum of the earth said nobody at all today in this town hall"]
