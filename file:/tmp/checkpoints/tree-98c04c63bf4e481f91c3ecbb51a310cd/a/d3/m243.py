x243