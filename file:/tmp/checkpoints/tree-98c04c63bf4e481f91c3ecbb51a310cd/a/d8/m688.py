x688