x206