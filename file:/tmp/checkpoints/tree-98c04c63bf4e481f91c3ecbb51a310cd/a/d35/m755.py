x755