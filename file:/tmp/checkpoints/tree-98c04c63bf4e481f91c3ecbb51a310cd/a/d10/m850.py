x850