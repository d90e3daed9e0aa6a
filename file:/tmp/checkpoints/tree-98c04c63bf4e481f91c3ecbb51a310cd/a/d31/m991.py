x991