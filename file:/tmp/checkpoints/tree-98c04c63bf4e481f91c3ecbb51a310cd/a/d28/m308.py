x308