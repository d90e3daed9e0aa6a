x621