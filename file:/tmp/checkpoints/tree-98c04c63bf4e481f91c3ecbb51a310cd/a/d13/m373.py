x373