x916