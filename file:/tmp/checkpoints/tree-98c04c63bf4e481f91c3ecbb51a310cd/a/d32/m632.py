x632