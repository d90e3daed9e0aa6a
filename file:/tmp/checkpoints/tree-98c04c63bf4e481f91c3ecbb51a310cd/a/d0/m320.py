x320