x304