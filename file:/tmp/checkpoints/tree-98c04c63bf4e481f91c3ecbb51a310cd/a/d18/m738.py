x738