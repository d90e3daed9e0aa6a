x24