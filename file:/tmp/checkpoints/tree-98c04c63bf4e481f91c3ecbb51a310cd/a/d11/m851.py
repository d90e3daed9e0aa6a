x851