x994