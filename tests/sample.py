"""A small project of our own, in four languages, for the pipeline's query and tests."""

FILES = {
    "src/lib.rs": "//! Orders.\npub mod errors;\npub mod services;\n",
    "src/errors.rs": "use std::fmt;\n\nuse thiserror::Error;\n\n#[derive(Debug, Error)]\npub enum OrderError {\n    Missing,\n}\n",
    "src/services/orders.rs": "use std::collections::HashMap;\n\nuse serde::Serialize;\nuse tracing::info;\n\nuse crate::errors::OrderError;\n\n#[derive(Serialize)]\npub struct Order {\n    id: u64,\n}\n\n/// Finds an order.\npub async fn find_order(id: u64) -> Result<Order, OrderError> {\n    info!(\"find\");\n    load(id)\n}\n\nfn load(order_id: u64) -> Result<Order, OrderError> {\n    Ok(Order { id: order_id })\n}\n",
    "web/src/api-client.ts": "import axios from 'axios';\nimport type { Order } from './order-types';\n\nexport class ApiError extends Error {}\n\nexport async function fetchOrder(orderId: number): Promise<Order> {\n  return axios.get('/o/' + orderId);\n}\n",
    "web/src/order-types.ts": "export interface Order {\n  id: number;\n}\n",
    "web/src/index.ts": "export * from './api-client';\nexport * from './order-types';\n",
    "web/src/api-client.test.ts": "import { describe, it } from 'vitest';\nimport { fetchOrder } from './api-client';\n\ndescribe('api', () => {\n  it('works', () => { fetchOrder(1); });\n});\n",
    "tools/report.cjs": "const { sum } = require('lodash');\nmodule.exports = { total: sum };\n",
    "py/app/models.py": "\"\"\"Models.\"\"\"\nfrom dataclasses import dataclass\n\nfrom pydantic import BaseModel\n\n__all__ = [\"Item\"]\n\n\nclass ItemError(Exception):\n    pass\n\n\n@dataclass\nclass Item:\n    name: str\n",
    "py/app/service.py": "import logging\n\nimport requests\n\nfrom .models import Item\n\nlog = logging.getLogger(__name__)\n\n\ndef load_item(name: str) -> Item:\n    log.info(\"load\")\n    return Item(requests.get(name).text)\n",
    "py/tests/test_service.py": "import pytest\n\nfrom app.service import load_item\n\n\n@pytest.fixture\ndef item():\n    return load_item(\"x\")\n\n\ndef test_load_item(item):\n    assert item\n",
    "py/broken.py": "def (:\n",
}
