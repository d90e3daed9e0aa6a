x136