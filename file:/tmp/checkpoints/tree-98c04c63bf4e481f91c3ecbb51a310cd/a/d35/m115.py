x115