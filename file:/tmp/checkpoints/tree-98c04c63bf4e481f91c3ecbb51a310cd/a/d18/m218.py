x218