x409