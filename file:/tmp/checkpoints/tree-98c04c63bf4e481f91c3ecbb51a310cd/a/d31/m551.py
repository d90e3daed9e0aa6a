x551