x126