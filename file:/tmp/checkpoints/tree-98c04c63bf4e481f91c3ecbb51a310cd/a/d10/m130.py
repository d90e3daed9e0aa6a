x130