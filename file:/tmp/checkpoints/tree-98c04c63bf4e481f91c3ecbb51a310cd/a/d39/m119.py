x119