x542