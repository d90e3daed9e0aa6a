x140